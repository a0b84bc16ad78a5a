"""Text predicates and normalisations as Column expressions.

All are built-in functions, so they stay in generated code and push down like any other expression. Patterns use explicit classes
instead of \\s, \\w and \\b, whose meaning differs between engines. A null text gives null unless stated.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the characters that count as white space -------------------------------------------------------------------------
WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# ---- fixed values: title words ------------------------------------------------------------------------------------------------------
SKIPPABLE_TITLES = ("index", "endnotes", "notes", "bibliography", "acknowledg", "about the author")
BACK_TITLES = ("notes", "endnotes", "index", "bibliography", "references", "acknowledg", "about the author")
FRONT_TITLES = ("front matter", "title page", "half title", "copyright", "contents", "dedication", "epigraph", "praise for")
BACK_KEY_PARTS = ("notes", "index", "bibliography", "references", "acknowledg")
BACK_KEY_STARTS = ("alsoby", "anoteabout", "abouttheauthor", "furtherreading", "newslettersign")
BACK_KEYS = ("notes", "index", "bibliography", "references", "acknowledgments", "acknowledgements", "copyright")
FRONT_KEYS = ("titlepage", "halftitle", "contents", "tableofcontents", "dedication", "epigraph", "frontispiece")
FRONT_KEY_STARTS = ("copyright", "praise", "alsoby")
HEADING_WORDS = ("chapter", "part", "prologue", "epilogue", "introduction", "foreword", "preface", "afterword", "appendix", "conclusion")
CHAPTER_LABELS = ("prologue", "epilogue", "aftermath", "afterword", "foreword", "preface", "introduction", "conclusion", "appendix", "author", "part", "chapter", "book")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DEPICTIONS = ("Image", "Photograph", "Photo", "Portrait", "Cartoon", "Illustration", "Map", "Poster", "Facsimile", "Front page", "Cover")
PLACES_IN_PHOTO = ("right", "left", "center", "centre", "top", "bottom", "above", "below")
# ---- fixed values: limits of the layout rules ---------------------------------------------------------------------------------------
HEADING_RATIO, LEVEL_ONE_RATIO = 1.45, 1.9
HEADING_WORDS_MAX, LABEL_WORDS_MAX = 12, 6
CAPTION_WORDS_MAX, CREDIT_WORDS_MAX, SCENE_WORDS_MAX = 12, 40, 6
TITLE_DIGITS_MAX, TITLE_CASE_SHARE, SHORT_LETTERS, SHORT_SHARE = 2, 0.6, 3, 0.5
REAL_WORD_LETTERS, REAL_WORD_SHARE = 4, 0.25
# ---- fixed values: length bands and features of paragraphs --------------------------------------------------------------------------
BANDS = (("short", 15, 34), ("medium", 35, 79), ("long", 80, None))
#: A word character before or after what must be whole; lookarounds aren't used, so the patterns also run on RE2.
EDGE = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
STRATA = {
    "digits": r"\p{Nd}",
    "year": EDGE[0] + r"(1[89]\p{Nd}\p{Nd}|20\p{Nd}\p{Nd})" + EDGE[1],
    "acronym": EDGE[0] + r"[A-Z]{2,6}" + EDGE[1],
    "quotes": r"[\x{201C}\x{201D}\x{22}]",
    "dash": r"[\x{2014}\x{2013}]",
    "parenthetical": r"\([^)]{3,}\)",
    "citation": r"\[\p{Nd}+\]|\(\p{Nd}{4}\)",
    "hyphen_break": rf"[a-z]-[{WS}]+[a-z]",
    "non_ascii": r"[^\x{00}-\x{7F}]",
    "colon_lead": rf":[{WS}]*\z",
}

VOWEL_RUN, CONSONANT_RUN = "[aeiou]{3,}", "[bcdfghjklmnpqrstvwxz]{4,}"
CLOSERS = r"\x{201D}\x{2019}\x{22}'\)\]\x{BB}"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def strip(text: Column) -> Column:
    """Without white space (29 characters; not the zero-width ones) at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{WS}]+", ""), rf"[{WS}]+\z", "")


def collapse(text: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, f"[{WS}]+", " "))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS}]")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^{WS}]+)"), F.lit(1))


def word_count(text: Column) -> Column:
    # runs of what isn't white space; visible ASCII is told by one comparison, and possessive repetition keeps no way back
    return F.regexp_count(text, F.lit(f"(?:[!-~]++|[^{WS}])++"))


def head_key(text: Column) -> Column:
    """Letters and underscores in lower case: what stays the same in a running head with changing page numbers."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}_]", ""))


def title_contains(title: Column, parts: tuple[str, ...]) -> Column:
    """Whether a title, in lower case, contains one of the parts; a null title doesn't. One pass for all parts, which begin and end with no blank."""
    return F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", p) for p in parts))


def is_skippable_title(title: Column) -> Column:
    return title_contains(title, SKIPPABLE_TITLES)


def is_back_title(title: Column) -> Column:
    return title_contains(title, BACK_TITLES)


def is_front_title(title: Column) -> Column:
    return title_contains(title, FRONT_TITLES)


def names_back_matter(title: Column) -> Column:
    """Of a heading in a layout: its key contains or begins with a section name."""
    key = head_key(F.coalesce(title, F.lit("")))
    return (F.length(key) > 0) & any_of([*[key.contains(p) for p in BACK_KEY_PARTS], *[key.startswith(p) for p in BACK_KEY_STARTS]])


def names_front_matter(title: Column) -> Column:
    """Of an outline entry: without any word character, or a front-matter key. A title of digits is none."""
    title = F.coalesce(title, F.lit(""))
    key = head_key(title)
    return is_contentless(title) | ((F.length(key) > 0) & (key.isin(*FRONT_KEYS) | any_of([key.startswith(p) for p in FRONT_KEY_STARTS])))


def is_page_number(text: Column) -> Column:
    return text.rlike(rf"^[{WS}]*(\p{{Nd}}+\.?|[ivxlcdmIVXLCDM]+)[{WS}]*\z")


def is_digit_token(text: Column) -> Column:
    """One token that holds a digit."""
    return text.rlike(rf"^[{WS}]*[^{WS}]*\p{{Nd}}[^{WS}]*[{WS}]*\z")


def is_garbled_page_number(text: Column) -> Column:
    """A digit token in which every run of letters is too short for a word or a roman numeral."""
    return is_digit_token(text) & ~text.rlike(r"(?<!\p{L})(?![ivxlcdmIVXLCDM]+(?!\p{L}))\p{L}{3,}")


def is_uri(text: Column) -> Column:
    return text.rlike(rf"^[{WS}]*(?i:https?|ftp)://[^{WS}]+[{WS}]*\z")


def is_contentless(text: Column) -> Column:
    return ~text.rlike(r"[\p{L}\p{M}\p{N}_]")


def is_droppable(text: Column) -> Column:
    """Of a paragraph: nothing in it, a page number, or one token with a digit."""
    return is_contentless(text) | is_page_number(text) | is_digit_token(text)


def is_furniture(text: Column, is_running_head: Column) -> Column:
    """Of a line in the margin: not part of the text."""
    return is_page_number(text) | (F.length(head_key(text)) == 0) | is_running_head | is_garbled_page_number(strip(text)) | is_uri(text)


def starts_with_word(text: Column, options: tuple[str, ...]) -> Column:
    """Begins with one of the words, in any case, as a whole word."""
    return F.lower(text).rlike(rf"^({'|'.join(options)})([^\p{{L}}\p{{N}}_]|\z)")


def is_numbered_title(text: Column) -> Column:
    return text.rlike(rf"^\p{{Nd}}{{1,3}}[.)][{WS}]+[^{WS}]")


def has_real_run(text: Column) -> Column:
    return text.rlike(r"\p{L}{3,}")


def is_heading_line(text: Column, size: Column, body_size: Column, in_outline: Column) -> Column:
    """A short line that is set larger than the body, or reads like a chapter label."""
    t = strip(text)
    n = word_count(t)
    shaped = n.between(1, HEADING_WORDS_MAX) & ~t.rlike(r"[,;:]\z") & (has_real_run(t) | in_outline)
    label = (n <= LABEL_WORDS_MAX) & ~t.rlike(r"[.!?]\z") & (starts_with_word(t, HEADING_WORDS) | is_numbered_title(t) | names_back_matter(t))
    return shaped & ((size >= body_size * HEADING_RATIO) | label)


def heading_level(size: Column, body_size: Column) -> Column:
    return F.when(size >= body_size * LEVEL_ONE_RATIO, 1).otherwise(2)


def is_caption(text: Column) -> Column:
    t = strip(text)
    n = word_count(t)
    name = r"[A-Z][\p{L}\p{N}_.'\x{2019}-]*"
    short = (t.startswith("(") & t.endswith(")")) | t.rlike(rf"\([^)]{{2,}}\)[{WS}]*\z")
    credit = t.rlike(rf"\({name}([{WS}]+{name}){{0,3}}\)[{WS}]*\z")
    placed = F.lower(t).rlike(rf"\(({'|'.join(PLACES_IN_PHOTO)})\)")
    depicts = t.rlike(rf"^({'|'.join(DEPICTIONS)}) of([^\p{{L}}\p{{N}}_]|\z)")
    return ((n <= CAPTION_WORDS_MAX) & short) | ((n <= CREDIT_WORDS_MAX) & (credit | placed | depicts))


def looks_incomplete(text: Column) -> Column:
    """Doesn't end a sentence, closing quotes and brackets aside."""
    after = rf"[{WS}]*[{CLOSERS}]*[{WS}]*\z"
    return ~text.rlike(rf"\A{after}") & ~text.rlike(rf"[.!?\x{{2026}}]{after}")


def starts_lowercase(text: Column) -> Column:
    """The first letter is a small one."""
    return text.rlike(r"^\P{L}*\p{Ll}")


def is_scene_setter(text: Column) -> Column:
    """A short line with only a date, or a place and its region."""
    t = strip(text)
    date = t.rlike(rf"^({'|'.join(MONTHS)})([{WS}]+\p{{Nd}}{{1,2}},?)?[{WS}]+\p{{Nd}}{{4}}\z")
    name = r"[A-Z][\p{L}\p{N}_.'\x{2019}-]*"
    place = t.rlike(rf"^{name}([{WS}]+{name}){{0,2}},[{WS}]+[A-Z][\p{{L}}\p{{N}}_.'\x{{2019}} -]+\z")
    return (word_count(t) <= SCENE_WORDS_MAX) & looks_incomplete(t) & (date | place)


def letter_runs(text: Column) -> Column:
    """How many words of letters alone."""
    return F.regexp_count(text, F.lit(r"\p{L}+"))


def is_title_cased(text: Column) -> Column:
    n = letter_runs(text)
    return (n >= 2) & (F.regexp_count(text, F.lit(r"(?<!\p{L})\p{Lu}")) >= TITLE_CASE_SHARE * n)


def is_wordlike(text: Column) -> Column:
    """Every word could be one, and not most of them are tiny."""
    low, n = F.lower(text), letter_runs(text)
    vowelless = text.rlike(r"(?<!\p{L})[\p{L}&&[^aeiouyAEIOUY\x{130}]]{2,}(?!\p{L})")  # U+0130 is an i in lower case
    tiny = F.regexp_count(text, F.lit(rf"(?<!\p{{L}})\p{{L}}{{1,{SHORT_LETTERS}}}(?!\p{{L}})"))
    return ~(vowelless | low.rlike(f"{VOWEL_RUN}|{CONSONANT_RUN}")) & ~((n > 0) & (tiny > SHORT_SHARE * n))


def is_strong_chapter(text: Column, size: Column, body_size: Column) -> Column:
    """A heading that surely opens a chapter."""
    outlier = (size >= body_size * HEADING_RATIO) & word_count(text).between(2, HEADING_WORDS_MAX)
    clean = (F.regexp_count(text, F.lit(r"\p{Nd}")) <= TITLE_DIGITS_MAX) & ~text.rlike(r"[=<>\x{A9}\x{AE}+&~|/\\{}\[\]]") & ~text.rlike(r"[.!?]\z")
    return starts_with_word(text, CHAPTER_LABELS) | is_numbered_title(text) | (outlier & clean & is_title_cased(text) & is_wordlike(text))


def real_words(text: Column) -> Column:
    """How many tokens, by their letters alone, could be words."""
    letters = F.lower(F.regexp_replace(text, rf"[^\p{{L}}{WS}]", ""))
    token = r"[\p{L}\x{307}]"  # the dot that an i of Turkish leaves
    return F.regexp_count(letters, F.lit(rf"(?<!{token})(?={token}{{{REAL_WORD_LETTERS}}})(?={token}*[aeiouy])(?!{token}*({VOWEL_RUN}|{CONSONANT_RUN})){token}+"))


def is_gibberish(text: Column) -> Column:
    """Hardly any token is a real word; true of a text without tokens."""
    n = word_count(text)
    return (n == 0) | (real_words(text) < F.greatest(F.lit(1.0), REAL_WORD_SHARE * n))


def dehyphenate(line: Column, following: Column) -> Column:
    """Both lines as one where the first breaks a word with a hyphen, else null. The hyphen stays before a capital."""
    broken = line.rlike(r"\p{L}-\z") & following.rlike(r"^\p{L}")
    stem = line.substr(F.lit(1), F.length(line) - 1)
    return F.when(broken, F.concat(F.when(following.rlike(r"^\p{Lu}"), line).otherwise(stem), following))


def band_of(n_words: Column) -> Column:
    """The length band; fewer words than the first band has belong to it as well."""
    out = F.when(n_words >= BANDS[2][1], BANDS[2][0]).when(n_words >= BANDS[1][1], BANDS[1][0])
    return out.otherwise(BANDS[0][0])


def strata_of(text: Column) -> Column:
    """Names, in order, of the features that the text shows."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in STRATA.items()]), lambda x: x.isNotNull())


def clean_title(title: Column) -> Column:
    """Without what download sites add to titles, with blanks for underscores."""
    out = title
    for junk in (r"(?i)^_?OceanofPDF\.com_?", r"(?i)\([ ]*z-library[^)]*\)", r"(?i)\([ ]*[^)]*z-lib[^)]*\)", r"(?i)\([ ]*1lib[^)]*\)"):
        out = F.regexp_replace(out, junk, "")
    out = F.regexp_replace(F.replace(out, F.lit("_"), F.lit(" ")), f"[{WS}]+", " ")
    return F.regexp_replace(F.regexp_replace(out, "^[ -]+", ""), r"[ -]+\z", "")


def stem(word: Column) -> Column:
    """Without up to two last letters, at least three stay."""
    low = F.lower(word)
    return low.substr(F.lit(1), F.greatest(F.lit(3), F.length(low) - 2))


def _escaped(literal: Column) -> Column:
    return F.regexp_replace(literal, r"([\\.^$|?*+()\[\]{}-])", r"\\$1")


def contains_rendering(rendering: Column, text: Column) -> Column:
    """Each word of the rendering occurs with its stem at the beginning of a word."""
    return F.forall(words(rendering), lambda w: F.rlike(F.lower(text), F.concat(F.lit(EDGE[0]), _escaped(stem(w)))))


def term_occurrences(term: Column, text: Column) -> Column:
    """How often the term occurs as whole words, in any case; an empty term never does."""
    # neighbours share the character between them, so it is doubled first
    spaced = F.regexp_replace(F.lower(text), r"([^\p{L}\p{N}_])", "$1$1")
    inner = F.regexp_replace(F.lower(term), r"([^\p{L}\p{N}_])", "$1$1")
    return F.when(F.length(term) == 0, 0).otherwise(F.regexp_count(spaced, F.concat(F.lit(EDGE[0]), _escaped(inner), F.lit(EDGE[1]))))


def normalize_lang(lang: Column) -> Column:
    """The primary subtag in lower case."""
    return F.split(F.lower(strip(lang)), "[-_]")[0]


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def emphasis_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("<(em|strong|i|b)>"))


def parse_score(reply: Column, low: int, high: int) -> Column:
    """The first `SCORE: n` of a reply, null out of range or without one."""
    n = F.regexp_extract(reply, rf"(?i)SCORE:[{WS}]*(-?[0-9]+)", 1).try_cast("int")
    return F.when(n.between(low, high), n)


def parse_verdict(reply: Column) -> Column:
    """True for a reply that begins with yes, false for no, null for any other."""
    t = F.lower(strip(reply))
    return F.when(t.startswith("yes"), True).when(t.startswith("no"), False)


def parse_numbered(reply: Column, expected: Column) -> Column:
    """The texts after the markers [[1]] to [[n]]: markers at line beginnings first, else anywhere. Null unless they are exactly those,
    each once, none with a blank text."""

    def split_on(pattern: str) -> Column:
        numbers = F.regexp_extract_all(reply, F.lit(pattern), F.lit(1))
        parts = F.split(reply, pattern.replace("(", "").replace(")", "").replace("?m", "(?m)"))
        texts = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), strip)
        numbered = F.sort_array(F.arrays_zip(F.transform(numbers, lambda x: x.cast("int")).alias("n"), texts.alias("t")))
        exact = F.transform(numbered, lambda x: x["n"]) == F.sequence(F.lit(1), F.greatest(expected, F.lit(1)))
        full = F.forall(numbered, lambda x: F.length(x["t"]) > 0)
        return F.when((F.size(numbers) == expected) & (expected > 0) & exact & full, F.transform(numbered, lambda x: x["t"]))

    return F.coalesce(split_on(r"(?m)^[ \t]*\[\[([0-9]+)\]\][ \t]*"), split_on(r"\[\[([0-9]+)\]\]"))


def format_size(n_bytes: Column) -> Column:
    """`x,y MB` from one megabyte on, else `n kB`, at least 1. Halves go by the double's exact value (1.15 is below its half), then to even.

    format_string would round up the double's shortest decimals instead.
    """
    mega = F.concat(F.replace(F.call_function("format_number", n_bytes / 1_000_000, F.lit("0.0")), F.lit("."), F.lit(",")), F.lit(" MB"))
    return F.when(n_bytes >= 1_000_000, mega).otherwise(F.format_string("%d kB", F.greatest(F.lit(1).cast("long"), F.bround(n_bytes / 1000).cast("long"))))

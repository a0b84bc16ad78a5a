import random

import pytest
from pyspark.sql import functions as F

from folioflux.functions import identity, money, text
from folioflux.functions.unicode import casefold, slugify


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", column(F.col("t"))).collect())]


def test_white_space_is_that_of_every_code_point(spark):
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    got = values(spark, text.strip, [f"{p}x{p}" for p in points])
    assert [p for p, g in zip(points, got, strict=True) if g == "x"] == [p for p in points if p.isspace()]
    assert values(spark, text.word_count, [f"a{p}b" for p in points]) == [len(f"a{p}b".split()) for p in points]


def test_strip_and_collapse(spark):
    rows = [" a  b \u0085", "​a", "", "\n\t", "a\x1cb"]
    assert values(spark, text.strip, rows) == [r.strip() for r in rows]
    assert values(spark, text.collapse, rows) == [" ".join(r.split()) for r in rows]


@pytest.mark.parametrize(
    ("predicate", "yes", "no"),
    [
        (text.is_page_number, ["12", " 7. ", "xiv", "MCM"], ["12a", "xivy", "", "1 2"]),
        (text.is_garbled_page_number, ["40OI1", "Il0", "XXV1", "12"], ["COVID-19", "MiG-29", "9/11-era", "no digit", "a 1"]),
        (text.is_uri, ["https://x.org/a", " FTP://y "], ["see http://x", "http:// x"]),
        (text.is_contentless, ["", " ...", "—"], ["a", "_", "1"]),
        (text.is_droppable, ["", "iv", "p=17628."], ["word", "two 2"]),
        (text.looks_incomplete, ["and then", "he said “no”", "a,"], ["Done.", "“Done.”", "What?)", "", "wait…"]),
        (text.starts_lowercase, ["abc", "1. abc", "“quoted"], ["Abc", "123", "", "É"]),
        (text.is_caption, ["(National Library)", "Voices on it. (Elizabeth Spaulding)", "Strauss (right), speaking with others", "Photograph of a tree"], ["Plain text.", "He left (and came back) at once, they said, but nobody believed it at all then."]),
        (text.is_scene_setter, ["November 2020", "May 3, 1999", "Fort Meade, Maryland"], ["November 2020.", "a place, Somewhere", "In November 2020 we all went to Maryland"]),
        (text.is_title_cased, ["The Big House", "THE END"], ["The", "the big House", ""]),
        (text.is_wordlike, ["Closet of Secrets", "Dirty Business"], ["Tg Pst", "Uiindicaerces House", "Or iar Ta"]),
        (text.is_gibberish, ["Pel OO ays por Umi", "wa", ""], ["Bloomsbury Publishing Inc.", "real words here"]),
        (text.names_back_matter, ["Notes: What", "Endnotes", "About the Author", "Bibliography"], ["Chapter 1", "123", ""]),
        (text.names_front_matter, ["Contents", "Praise for X", "...", "Title Page"], ["1984", "A Chapter"]),
        (text.is_skippable_title, ["Index", " ENDNOTES ", "Acknowledgments"], ["Chapter", "", "References"]),
        (text.is_front_title, ["Front Matter", "Copyright"], ["Chapter"]),
        (text.is_numbered_title, ["12. Dirty Business", "3) x"], ["1234. x", "12.x", "a 1."]),
    ],
)
def test_predicates(spark, predicate, yes, no):
    assert values(spark, predicate, yes) == [True] * len(yes)
    assert values(spark, predicate, no) == [False] * len(no)


def test_heading_lines(spark):
    rows = [("Any Short Line", 20.0, True), ("chapter one", 10.0, True), ("Chapter one ends.", 10.0, False), ("NOTES", 10.0, True), ("7 me 1%", 20.0, False), ("Ends with comma,", 20.0, False), ("1984", 20.0, False), (" ".join(["word"] * 13), 20.0, False)]
    df = spark.createDataFrame(rows, "t string, size double, want boolean")
    got = df.select(text.is_heading_line(F.col("t"), F.col("size"), F.lit(10.0), F.lit(False)).alias("h"), "want").collect()
    assert [r["h"] for r in got] == [r["want"] for r in got]
    assert spark.createDataFrame([("1984",)], "t string").select(text.is_heading_line(F.col("t"), F.lit(20.0), F.lit(10.0), F.lit(True))).first()[0]


def test_strata(spark):
    rows = ["In 1984 x", "19845", "NATO said", "xNATO", "say “no”", "a — b", "so (called) it", "see [12]", "informa- tion", "café", "as follows: ", "plain"]
    want = [["digits", "year"], ["digits"], ["acronym"], [], ["quotes", "non_ascii"], ["dash", "non_ascii"], ["parenthetical"], ["digits", "citation"], ["hyphen_break"], ["non_ascii"], ["colon_lead"], []]
    assert values(spark, text.strata_of, rows) == want


def test_dehyphenate(spark):
    rows = [("exam-", "ple", "example"), ("anti-", "American", "anti-American"), ("x1-", "a", None), ("-", "a", None), ("word", "a", None), ("exam-", "1", None)]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert [r[0] == r[1] for r in df.select(text.dehyphenate(F.col("a"), F.col("b")).alias("g"), "want").collect()] == [True] * len(rows)


def test_terms_match_whole_words_and_stems(spark):
    rows = [("UN", "The UN, un and united UN", 3), ("a b", "a b a b", 2), ("C++", "c++ and C++x", 1), ("", "x", 0), ("x", "x x x", 3)]
    df = spark.createDataFrame(rows, "term string, t string, n int")
    assert all(r[0] == r[1] for r in df.select(text.term_occurrences(F.col("term"), F.col("t")), "n").collect())
    rows = [("velika hiša", "v velikih hišah", True), ("hiša", "prehiša", False), ("an", "another", True), ("", "x", True)]
    df = spark.createDataFrame(rows, "r string, t string, want boolean")
    assert all(r[0] == r[1] for r in df.select(text.contains_rendering(F.col("r"), F.col("t")), "want").collect())


def test_replies(spark):
    rows = [("[[1]] a\n[[2]] b [[3]] c", 2, ["a", "b [[3]] c"]), ("[[1]] a [[2]] b", 2, ["a", "b"]), ("[[2]] b\n [[1]] a", 2, ["a", "b"]), ("[[1]] a\n[[1]] b", 2, None), ("[[1]] a\n[[2]]  ", 2, None), ("none", 1, None), ("pre [[1]] x", 1, ["x"])]
    df = spark.createDataFrame(rows, "t string, n int, want array<string>")
    for r in df.select(text.parse_numbered(F.col("t"), F.col("n")).alias("g"), "want", "t").collect():
        assert r["g"] == r["want"], r["t"]
    from folioflux.plans.execute import parse_numbered

    assert [parse_numbered(t, n) for t, n, _ in rows] == [w for _, _, w in rows]
    assert values(spark, lambda c: text.parse_score(c, 1, 5), ["score: 4", "SCORE:9", "x", "SCORE: -1"]) == [4, None, None, None]
    assert values(spark, text.parse_verdict, [" Yes, ", "no", "maybe"]) == [True, False, None]


def test_small_formats(spark):
    assert values(spark, text.normalize_lang, [" sl-SI ", "DE_at", "en"]) == ["sl", "de", "en"]
    assert values(spark, text.clean_title, ["_OceanofPDF.com_My_Book (z-library.sk)", " -a - "]) == ["My Book", "a"]
    assert values(spark, slugify, ["Čas & Café: ein Buch!", "漢字", "a b c d e f g h i"]) == ["cas-cafe-ein-buch", "untitled", "a-b-c-d-e-f-g-h"]
    assert values(spark, casefold, ["STRASSE", "straße", None]) == ["strasse", "strasse", None]
    df = spark.createDataFrame([(0,), (1499,), (1500,), (2_449_000,), (999_999,)], "n long")
    assert [r[0] for r in df.select(text.format_size(F.col("n"))).collect()] == ["1 kB", "1 kB", "2 kB", "2,4 MB", "1000 kB"]


def test_identity_is_sha1_over_stripped_text(spark):
    import hashlib

    rng = random.Random(1)
    rows = [(rng.randrange(5), i, "".join(rng.choice(" \u0085aé​😀\n") for _ in range(8))) for i in range(60)]
    df = spark.createDataFrame(rows, "chapter int, position long, t string").select("chapter", "position", "t", identity.segment_id(F.col("t"), F.col("chapter"), F.col("position")).alias("id"), identity.segment_hash(F.col("t")).alias("h"))
    for r in df.collect():
        assert r["id"] == hashlib.sha1(f"{r['chapter']}:{r['position']}:{r['t'].strip()}".encode()).hexdigest() and r["h"] == hashlib.sha1(r["t"].strip().encode()).hexdigest()
    terms = spark.createDataFrame([({"b": "2", "a": "1"},), ({"a": "1", "b": "2"},), ({},), (None,)], "m map<string,string>")
    a, b, c, d = [r[0] for r in terms.select(identity.glossary_identity(F.col("m"))).collect()]
    assert a == b != c == d


def test_sizes_at_a_half_are_rounded_by_the_exact_double(spark):
    sizes = [50_000 * n for n in range(20, 400)]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert [r[0] for r in df.select(text.format_size(F.col("n"))).collect()] == [f"{n / 1_000_000:.1f} MB".replace(".", ",") for n in sizes]


def test_prices(spark):
    with pytest.raises(ValueError, match="gpt-5-mini"):
        money.require_priced("free-model")
    assert money.is_reasoning_model("gpt-5-nano") and not money.is_reasoning_model("claude-opus-4-1")
    rows = spark.createDataFrame([(1.5, 100_000), (4.5, 100_000), (3.0, 100_000), (None, 1), (1.0, 0)], "c double, n long")
    assert [r[0] for r in rows.select(money.efficiency(F.col("c"), F.col("n"))).collect()] == [1.0, 0.0, 0.5, None, 1.0]

"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

A text is normalised to its words (runs of [0-9a-z] and of characters beyond ASCII, A-Z lower-cased) with single blanks between;
one automaton over that finds every place of every phrase in one pass, however many phrases there are. Of notices that overlap the
longest stands: "lesser general public license" is not a notice of the general one. Where the automaton finds the tag
`SPDX-License-Identifier`, the expression after it in the raw text is parsed with the precedence with > and > or, and its names are
looked up in the identifiers and exceptions known.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioflux.llm import bytewords as bw
from folioflux.llm.columns import with_text_column

#: Phrases (as normalised words) of the contract's base and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notice phrases beyond the base, and their labels.
NOTICE_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "creative commons": "creative-commons",
    "released into the public domain": "public-domain",
    "boost software license": "bsl",
    "isc license": "isc",
    "eclipse public license": "epl",
}
#: The public licence list's identifiers that are in wide use; names are compared without regard to case.
IDENTIFIERS = (
    "0BSD", "AAL", "AFL-1.1", "AFL-1.2", "AFL-2.0", "AFL-2.1", "AFL-3.0", "AGPL-1.0-only", "AGPL-1.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.0", "Apache-1.1", "Apache-2.0", "APL-1.0",
    "Artistic-1.0", "Artistic-1.0-Perl", "Artistic-2.0", "BlueOak-1.0.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-3-Clause-LBNL", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1",
    "CC-BY-1.0", "CC-BY-2.0", "CC-BY-2.5", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-1.0", "CC-BY-NC-2.0", "CC-BY-NC-2.5", "CC-BY-NC-3.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-1.0", "CC-BY-NC-ND-2.0", "CC-BY-NC-ND-2.5", "CC-BY-NC-ND-3.0",
    "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-1.0", "CC-BY-NC-SA-2.0", "CC-BY-NC-SA-2.5", "CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-1.0", "CC-BY-ND-2.0", "CC-BY-ND-2.5", "CC-BY-ND-3.0", "CC-BY-ND-4.0", "CC-BY-SA-1.0", "CC-BY-SA-2.0",
    "CC-BY-SA-2.5", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-PDDC", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.0", "CECILL-2.1", "CECILL-B", "CECILL-C", "CPAL-1.0", "CPL-1.0", "ECL-2.0", "EFL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1",
    "EUPL-1.2", "FSFAP", "FTL", "GFDL-1.1-only", "GFDL-1.2-only", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "HPND", "ICU", "IJG", "IPL-1.0", "ISC", "JSON", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "Libpng", "LPPL-1.3c",
    "MirOS", "MIT", "MIT-0", "MPL-1.0", "MPL-1.1", "MPL-2.0", "MPL-2.0-no-copyleft-exception", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "NTP", "ODbL-1.0", "ODC-By-1.0", "OFL-1.0", "OFL-1.1", "OLDAP-2.8", "OpenSSL", "OSL-1.0",
    "OSL-2.0", "OSL-2.1", "OSL-3.0", "PDDL-1.0", "PHP-3.0", "PHP-3.01", "PostgreSQL", "PSF-2.0", "Python-2.0", "QPL-1.0", "RPL-1.5", "Ruby", "SISSL", "Sleepycat", "SSPL-1.0", "Unicode-3.0", "Unicode-DFS-2016", "Unlicense", "UPL-1.0",
    "Vim", "W3C", "WTFPL", "X11", "Zend-2.0", "Zlib", "ZPL-2.1",
)
#: The exceptions of the same list that are in wide use.
EXCEPTIONS = (
    "389-exception", "Autoconf-exception-2.0", "Autoconf-exception-3.0", "Bison-exception-2.2", "Bootloader-exception", "Classpath-exception-2.0", "eCos-exception-2.0", "Font-exception-2.0", "GCC-exception-2.0", "GCC-exception-3.1",
    "GPL-3.0-linking-exception", "i2p-gpl-java-exception", "Libtool-exception", "Linux-syscall-note", "LLVM-exception", "OCaml-LGPL-linking-exception", "OpenJDK-assembly-exception-1.0", "openvpn-openssl-exception",
    "Qt-GPL-exception-1.0", "Qt-LGPL-exception-1.1", "Swift-exception", "u-boot-exception-2.0", "Universal-FOSS-exception-1.0", "WxWindows-exception-3.1",
)
TAG = "spdx license identifier"
_TAGGED = re.compile(r"SPDX[^0-9A-Za-z\x80-\U0010ffff]+License[^0-9A-Za-z\x80-\U0010ffff]+Identifier\s*:?[ \t]*([^\r\n]*)", re.IGNORECASE)

#: How restrictive a licence family is, 0 (none) to 1 (all rights reserved). The longest beginning of a label decides.
RESTRICTION = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "0bsd": 0.05, "mit": 0.1, "isc": 0.1, "bsl": 0.1, "bsd": 0.15, "apache": 0.2, "creative-commons": 0.3, "cc-by": 0.3, "cc-by-sa": 0.5, "mpl": 0.5, "epl": 0.5,
    "blueoak": 0.1, "unicode": 0.1, "zlib": 0.1, "libpng": 0.1, "x11": 0.1, "postgresql": 0.1, "wtfpl": 0.05, "cddl": 0.5, "eupl": 0.6, "lgpl": 0.55, "gpl": 0.7, "sspl": 0.9, "busl": 0.9, "cc-by-nd": 0.75, "cc-by-nc": 0.8, "agpl": 0.85, "reserved": 1.0,
}
UNKNOWN = 0.6
#: What an exception (`with`) takes off.
EXCEPTION = 0.15

_TOKEN = re.compile(r"\s*(\(|\)|[0-9A-Za-z.+_:-]+)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def restriction(label: str) -> float:
    name = label.lower()
    known = [k for k in RESTRICTION if name == k or name.startswith((f"{k}-", f"{k}."))]
    return RESTRICTION[max(known, key=len)] if known else UNKNOWN


def parse_expression(expression: str) -> list[str] | None:
    """Postfix form (operators in lower case) of the longest beginning that is an expression's tokens; None if it isn't one.

    Identifiers, parentheses and the operators and, or, with in any case; `with` binds most, then `and`; equals group to the left.
    `with` stands between two names, not after or before a parenthesis or another `with`.
    """
    output: list[str] = []
    stack: list[str] = []
    operand, at, before = True, 0, ""
    while m := _TOKEN.match(expression, at):
        token, word = m[1], m[1].lower()
        if token == "(":
            if not operand:
                break
            if before == "with":
                return None
            stack.append(token)
        elif token == ")":
            if operand or "(" not in stack:
                break
            while (top := stack.pop()) != "(":
                output.append(top)
        elif word in _PRECEDENCE:
            if operand or (word == "with" and (before == ")" or (stack and stack[-1] == "with"))):
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[word]:
                output.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            if not operand:
                break
            output.append(token)
            operand = False
        at, before = m.end(), word
    if operand or "(" in stack:
        return None
    return output + stack[::-1]


class Names:
    """The identifiers and exceptions that are known."""

    def __init__(self, identifiers: Iterable[str] = IDENTIFIERS, exceptions: Iterable[str] = EXCEPTIONS):
        self.identifiers, self.exceptions = {x.lower() for x in identifiers}, {x.lower() for x in exceptions}

    def licence(self, token: str) -> tuple[set[str], float]:
        """The label and restriction of one identifier. A `+` (or later) says nothing; `LicenseRef-` names are a document's own."""
        name = token.lower().removesuffix("+")
        if name in self.identifiers:
            return {f"spdx:{name}"}, restriction(name)
        return {"spdx:licenseref" if name.startswith(("licenseref-", "documentref-")) else "spdx-unknown"}, UNKNOWN


def evaluate(postfix: list[str], names: Names) -> tuple[set[str], float]:
    """The labels of the licences named, and how restrictive the whole is: `or` takes the freer side, `and` the stricter.

    A known exception takes something off its licence; an unknown one nothing, and adds the label `spdx-unknown`.
    """
    stack: list[tuple[set[str], float, str]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            stack.append((*names.licence(token), token))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            known = b[2].lower() in names.exceptions
            stack.append((a[0] if known else a[0] | {"spdx-unknown"}, max(0.0, a[1] - EXCEPTION) if known else a[1], ""))
        else:
            stack.append((a[0] | b[0], (min if token == "or" else max)(a[1], b[1]), ""))
    return stack[0][:2]


def automaton(base: dict[str, str], notices: dict[str, str]) -> ahocorasick.Automaton:
    """Of the phrases between blanks; a phrase of both kinds counts for both."""
    out = ahocorasick.Automaton()
    for phrase in {*base, *notices, TAG}:
        out.add_word(f" {phrase} ", (phrase, len(phrase) + 2))
    out.make_automaton()
    return out


_SPACED = bytes(b if b else 0x20 for b in bw.ALPHANUMERIC.tolist())


def _longest(found: list[tuple[int, int, str]]) -> set[str]:
    """The phrases with a place that no longer place holds. found: (first word, words, phrase)."""
    out, reach = set(), -1
    for first, n, phrase in sorted(found, key=lambda x: (x[0], -x[1])):
        if first + n > reach:
            out.add(phrase)
            reach = first + n
    return out


def scan_text(raw: bytes, machine: ahocorasick.Automaton, base: dict[str, str], notices: dict[str, str], names: Names) -> tuple[int, list[tuple[int, int, str]], list[str], list[str], float]:
    """Words, base places (word, words, label), other labels, expressions and the score of one text."""
    words = raw.translate(_SPACED).split()
    if not words:
        return 0, [], [], [], 0.0
    norm = f" {b' '.join(words).decode()} "
    found, at, index = [], 0, 0
    for end, (phrase, size) in machine.iter(norm):
        begin = end - size + 1
        index, at = index + (norm.count(" ", at, begin) if begin >= at else -norm.count(" ", begin, at)), begin
        found.append((index, phrase.count(" ") + 1, phrase))
    places = sorted((i, n, base[phrase]) for i, n, phrase in found if phrase in base)
    standing = _longest(found)
    labels = {notices[phrase] for phrase in standing if phrase in notices}
    scores = [restriction(x) for x in labels | {base[phrase] for phrase in standing if phrase in base}]
    expressions = []
    if TAG in standing:
        for m in _TAGGED.finditer(raw.decode()):
            if postfix := parse_expression(m[1]):
                named, score = evaluate(postfix, names)
                labels |= named
                expressions.append(" ".join(postfix))
                scores.append(score)
            else:
                labels.add("spdx-invalid")
                scores.append(UNKNOWN)
    return len(words), places, sorted(labels), expressions, max(scores, default=0.0)


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("label", T.StringType())]))),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("expressions", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()),
])


def scan_licenses(documents: DataFrame, *, text: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None, names: Names | None = None) -> DataFrame:
    """The documents, row by row, with `licenses`: struct of n_words, places (of base phrases: first word, words, label), labels (of
    notices and identifiers, and of the base; distinct and sorted), expressions (postfix) and score (0: nothing found or free, 1: all
    rights reserved; the strictest of what was found, expressions evaluated).

    A null text counts as empty: no words, nothing found, score 0. Overlapping and repeated base places all count as places and base
    labels; for other labels and the score the longest of overlapping phrases stands. Texts are read whole, one row at a time. Names
    that aren't known give the label `spdx-unknown`, a tag without a valid expression `spdx-invalid`. Other columns stay; one named
    `licenses` is replaced. An empty table gives no rows.
    """
    base, notices = BASE_PHRASES if base is None else base, NOTICE_PHRASES if notices is None else notices
    names = names or Names()
    place = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string())])

    def make() -> Callable[[pa.Array], pa.Array]:
        machine = automaton(base, notices)

        def of(texts: pa.Array) -> pa.Array:
            data, offsets = bw.buffers(texts)
            raw, cuts = data.tobytes(), offsets.tolist()
            rows = [scan_text(raw[a:b], machine, base, notices, names) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [
                pa.array(np.array([r[0] for r in rows], np.int64)),
                pa.array([[{"first_word": a, "n_words": n, "label": x} for a, n, x in r[1]] for r in rows], pa.list_(place)),
                pa.array([sorted({*r[2], *(p[2] for p in r[1])}) for r in rows], pa.list_(pa.string())),
                pa.array([r[3] for r in rows], pa.list_(pa.string())),
                pa.array([r[4] for r in rows], pa.float64()),
            ]
            return pa.StructArray.from_arrays(columns, [f.name for f in FOUND.fields])

        return of

    return with_text_column(documents, "licenses", FOUND, text, make)

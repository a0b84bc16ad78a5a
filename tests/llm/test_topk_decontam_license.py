import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.llm import decontam, licenses, topk

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall((t or "").translate(LOW))


# ---- exact top-k


@pytest.mark.parametrize("block", [4096, 3])
def test_topk_is_brute_force(spark, block):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 24)).round(2)
    vectors[50:60] = vectors[40]  # ties
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 10, query_block=block, shard_rows=64).collect()
    q = np.floor(1024 * vectors.astype(np.float32).astype(np.float64)).astype(np.int64)
    for i in range(0, 300, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:10]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == [(j, -s) for s, j in best]


def test_topk_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, None, "b"), (2, [1.0, None], "c"), (3, [nan, 1.0], "d"), (4, [inf, 1.0], "e"), (5, [0.5, 0.5], "f"), (5, [0.5, 0.5], "g"), (None, [9.0, 9.0], "h"), (6, [1.0], "i"), (7, [], "j"), (8, [], "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id").isin(0, 1, 3, 7), 10).collect()}
    assert got == {(0, 1, 5, 524288), (0, 2, 5, 524288), (7, 1, 8, 0)}
    assert topk.top_k(df.where("false"), F.lit(True), 3).count() == 0
    assert topk.top_k(df, F.lit(None).cast("boolean"), 3).count() == 0


def test_only_competing_vectors_are_probed():
    """Against all products: what maxscore returns is complete, and non-essential postings are read for survivors alone."""
    rng = np.random.default_rng(3)
    spread = np.r_[np.full(8, 400), np.full(56, 15)]
    shard = np.rint(rng.normal(size=(64, 4000)) * spread[:, None])
    low, high = shard.min(1), shard.max(1)
    for i in range(20):
        query = shard[:, i] * rng.choice([1, -1])
        all_scores = query @ shard
        floor = np.sort(all_scores)[-11]
        counts = []
        rows, scores = topk.maxscore(query, shard, low, high, floor, 11, counts)
        assert (scores == all_scores[rows]).all() and set(np.flatnonzero(all_scores >= floor)) <= set(rows.tolist())
        essential, others = counts
        # the bounds of terms with small weights can't reach the threshold: they are probed for few of the 4000 vectors
        assert essential % 4000 == 0 and essential < 64 * 4000 and 0 < others < (64 * 4000 - essential) // 4
        counts = []
        rows, _ = topk.maxscore(query, shard, low, high, np.maximum(query * low, query * high).sum() + 1, 11, counts)
        assert len(rows) == 0 and counts == [0, 0]  # a shard that can't compete isn't read


def test_bounds_are_stored_with_fixed_shards(spark, monkeypatch):
    written = []
    monkeypatch.setattr(topk, "keep", lambda df, name, keep=topk.keep, **how: written.append((name, keep(df, name, **how))) or written[-1][1])
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(230)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 5, query_block=1, shard_rows=50)
    assert got.count() == 23 * 5 and [n for n, _ in written].count("shards") == 1 and [n for n, _ in written].count("found") == 23
    for r in dict(written)["shards"].collect():
        matrix = np.frombuffer(r["postings"], np.int64).reshape(r["size"], len(r["ids"]))
        assert len(r["ids"]) <= 50 and r["low"] == matrix.min(1).tolist() and r["high"] == matrix.max(1).tolist()


def test_blocks_leave_nothing_behind_on_the_driver(spark, monkeypatch):
    dropped = []
    monkeypatch.setattr("pyspark.core.broadcast.Broadcast.unpersist", lambda self, blocking=False: dropped.append(len(self.value)))
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(100)]
    assert topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), 3, query_block=5).count() == 300
    assert len(dropped) == 20


def test_large_weights_stay_exact(spark):
    rows = [(0, [2.0**21, 1.0]), (1, [2.0**21, 1.0]), (2, [2.0**21, 1.0 + 1 / 1024]), (3, [1e300, 1.0]), (4, [-1.0, 0.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), 10).collect()}
    assert got[0, 1] == 2**62 + 2**20 and got[0, 2] == 2**62 + 2**20 + 1024 and got[0, 3] == (1 << 63) - 1 and got[0, 4] == -(2**41)


# ---- decontamination


def brute_contamination(text, items, n):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        own = words(t)
        size = min(n, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def contamination_case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "cé", "d1", "9", "ee", "Fox", "ß"])
    items = [(i, rng.choice([" ", "-", ", "]).join(word() for _ in range(rng.randrange(0, 16)))) for i in range(25)] + [(30, None), (None, "only this one phrase is without any id at all"), (10, "second text of ten")]
    docs = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40)))]
        if rng.random() < 0.4:
            parts += [(rng.choice(items)[1] or "").upper(), word()]
        docs.append((i, rng.choice([" ", "\n", ". "]).join(parts)))
    return [*docs, (None, items[3][1]), (500, None), (501, ""), (502, "...")], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
@pytest.mark.parametrize("n", [10, 3])
def test_contamination_is_brute_force(spark, n, block_bytes):
    docs, items = contamination_case(n)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, contamination string")
    got = decontam.find_contamination(d, spark.createDataFrame(items, "item_id long, text string"), n=n, block_bytes=block_bytes).collect()
    assert len(got) == len(docs)
    for r in got:
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], c["items"]) == brute_contamination(r["text"], items, n)
        raw = (r["text"] or "").encode()
        covered = [w for s in c["spans"] for w in words(raw[s["first_byte"] : s["end_byte"]].decode())]
        assert len(covered) == c["n_hit"] and covered == [w for s in c["spans"] for w in words(r["text"])[s["first_word"] : s["first_word"] + s["n_words"]]]


def test_blocks_of_a_benchmark_are_dropped_one_by_one(spark, monkeypatch):
    docs, items = contamination_case(5)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    dropped = []
    monkeypatch.setattr("pyspark.core.broadcast.Broadcast.unpersist", lambda self, blocking=False: dropped.append(len(self.value)))
    total = sum(len((t or "").encode()) + 64 for _, t in items)
    got = decontam.find_contamination(d, b, n=3, block_bytes=total // 20)
    rows = got.collect()
    assert len(dropped) >= 20 and sum(dropped) == len(items) and max(dropped) < 8
    assert all((r["contamination"]["n_words"], r["contamination"]["n_hit"], r["contamination"]["items"]) == brute_contamination(r["text"], items, 3) for r in rows)


def test_cutting_removes_the_spans_and_nothing_else(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before {item.upper()}, after."), (2, "clean text"), (3, item), (4, None)]
    cut = decontam.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), cut_spans=True)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Before , after.", 2: "clean text", 3: "", 4: None}


def test_empty_benchmark_and_documents(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contamination"]["n_hit"] for r in decontam.find_contamination(d, none).collect()] == [0]
    assert decontam.find_contamination(d.where("false"), none).count() == 0


# ---- licences


@pytest.mark.parametrize(
    ("expression", "postfix"),
    [
        ("MIT", ["MIT"]),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]),
        ("(MIT OR Apache-2.0) AND BSD-3-Clause", ["MIT", "Apache-2.0", "or", "BSD-3-Clause", "and"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0-only", "Classpath-exception-2.0", "with", "MIT", "or"]),
        ("a or b or c", ["a", "b", "or", "c", "or"]),
        ("MIT trailing words", ["MIT"]),
        ("MIT )", ["MIT"]),
        ("OR MIT", None), ("MIT AND", None), ("(MIT", None), ("", None), ("()", None),
    ],
)
def test_expressions(expression, postfix):
    assert licenses.parse_expression(expression) == postfix


@pytest.mark.parametrize("expression", ["(MIT OR ISC) WITH LLVM-exception", "GPL-2.0-only WITH (LLVM-exception)", "MIT WITH a WITH b", "MIT OR OR ISC", "AND"])
def test_what_is_no_expression(expression):
    assert licenses.parse_expression(expression) is None


def test_evaluation_takes_the_freer_of_or_and_the_stricter_of_and():
    of = lambda e: licenses.evaluate(licenses.parse_expression(e), licenses.Names())
    assert of("MIT OR GPL-3.0-only")[1] == licenses.restriction("mit")
    assert of("MIT AND GPL-3.0-only") == ({"spdx:mit", "spdx:gpl-3.0-only"}, licenses.restriction("gpl"))
    assert of("GPL-2.0-only WITH Classpath-exception-2.0") == ({"spdx:gpl-2.0-only"}, pytest.approx(licenses.restriction("gpl") - licenses.EXCEPTION))
    assert of("GPL-2.0+ WITH x") == ({"spdx:gpl-2.0", "spdx-unknown"}, licenses.restriction("gpl"))
    assert of("banana AND x") == ({"spdx-unknown"}, licenses.UNKNOWN)
    assert of("LicenseRef-Own OR CC0-1.0") == ({"spdx:licenseref", "spdx:cc0-1.0"}, 0.0)
    assert len({x.lower() for x in licenses.IDENTIFIERS}) == len(licenses.IDENTIFIERS) < 200


def random_expression(rng, depth=3):
    """An expression's text and its meaning, made together."""
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice(["MIT", "ISC", "GPL-3.0-only", "MPL-2.0", "Apache-2.0", "unheard-of"])
        known = name != "unheard-of"
        labels, score = ({f"spdx:{name.lower()}"}, licenses.restriction(name)) if known else ({"spdx-unknown"}, licenses.UNKNOWN)
        if rng.random() < 0.2:
            return f"{name} {rng.choice(['with', 'WITH'])} LLVM-exception", labels, max(0.0, score - licenses.EXCEPTION), 3
        return name, labels, score, 3
    op = rng.choice(["or", "and"])
    level = {"or": 1, "and": 2}[op]
    (a, la, sa, pa), (b, lb, sb, pb) = random_expression(rng, depth - 1), random_expression(rng, depth - 1)
    a = f"({a})" if pa < level or rng.random() < 0.2 and pa != 3 else a
    b = f"({b})" if pb <= level and pb != 3 else b
    return f"{a} {rng.choice([op, op.upper()])} {b}", la | lb, (min if op == "or" else max)(sa, sb), level


def test_expressions_mean_what_they_were_made_for():
    rng = random.Random(6)
    for _ in range(500):
        text, labels, score, _ = random_expression(rng)
        got = licenses.evaluate(licenses.parse_expression(text), licenses.Names())
        assert got == (labels, pytest.approx(score)), text


def brute_base(text):
    w = words(text)
    out = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        out += [(i, len(p), label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def test_base_places_are_brute_force(spark):
    rng = random.Random(4)
    bits = ["CC", "by", "General", "public", "License", "all rights", "reserved", "x", "cc-by", "GNU", "ccby", "Lesser", "nc", "sa", "the MIT license"]
    docs = [(i, rng.choice([" ", ".\n", "--"]).join(rng.choice(bits) for _ in range(rng.randrange(0, 40)))) for i in range(200)]
    docs += [(None, "All rights reserved."), (900, None), (901, ""), (902, "cc by cc by cc by")]
    rows = licenses.scan_licenses(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, licenses int")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        x = r["licenses"]
        n, places = brute_base(r["text"])
        assert x["n_words"] == n and [tuple(p) for p in x["places"]] == places
        assert set(p[2] for p in places) <= set(x["labels"]) and x["labels"] == sorted(set(x["labels"])) and 0 <= x["score"] <= 1
        assert (x["score"] > 0) == bool(x["labels"])
        # overlapping phrases: of each place only what no longer place holds counts
        every = [(i, i + len(p.split()), label) for p, label in [*licenses.BASE_PHRASES.items(), *licenses.NOTICE_PHRASES.items()] for i in range(n) if words(r["text"])[i : i + len(p.split())] == p.split()]
        standing = {label for a, b, label in every if not any(c <= a and b <= d and d - c > b - a for c, d, _ in every)}
        assert set(x["labels"]) == standing | {p[2] for p in places}
        assert x["score"] == max([licenses.restriction(label) for label in standing], default=0.0)


def test_tags_and_notices(spark):
    docs = [
        (1, "// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode"), (2, "SPDX-License-Identifier: AND\n"), (3, "Released under the MIT License."), (4, "spdx license identifier"),
        (5, "GNU Lesser General Public License"), (6, "SPDX-License-Identifier: banana AND x"), (7, "GNU Lesser General Public License, or the General Public License"),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == ["spdx:apache-2.0", "spdx:mit"] and got[1]["expressions"] == ["MIT Apache-2.0 or"] and got[1]["score"] == licenses.restriction("mit")
    assert got[2]["labels"] == ["spdx-invalid"] and got[3]["labels"] == ["mit"] and got[4]["labels"] == ["spdx-invalid"]
    assert got[5]["labels"] == ["gpl", "lgpl"] and [p["label"] for p in got[5]["places"]] == ["gpl"] and got[5]["score"] == licenses.restriction("lgpl")
    assert got[6]["labels"] == ["spdx-unknown"] and got[7]["score"] == licenses.restriction("gpl")

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioflux.llm import minhash
from folioflux.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(docs, size, similarity=(80, 100)):
    sets = [(d, shingles(t, size)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if a != b and s and t and similarity[1] * len(s & t) >= similarity[0] * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def corpus(seed):
    """Groups of copies with rising numbers of edits, chains of copies of copies, and copies whose original is missing."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    docs, n = [], 0

    def add(words):
        nonlocal n
        docs.append((n, " ".join(words)))
        n += 1

    for _ in range(12):
        base = [word() for _ in range(rng.randrange(3, 80))]
        add(base)
        current = base
        for k in range(rng.randrange(1, 14)):
            edited = list(current if rng.random() < 0.3 else base)
            for _ in range(rng.randrange(0, max(2, len(edited) // 6))):
                edited[rng.randrange(len(edited))] = word()
            if rng.random() < 0.3:
                edited = edited[rng.randrange(0, max(1, len(edited) // 8)) :]
            add(edited)
            current = edited
    for _ in range(60):
        add([word() for _ in range(rng.randrange(0, 30))])
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("size", [2, 5])
def test_components_are_those_of_all_pairs(spark, seed, size):
    docs = corpus(seed)
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(docs, size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("salt_rows", [minhash.SALT_ROWS, 3])
def test_hidden_links_are_found_in_buckets(spark, monkeypatch, salt_rows):
    """Bands of one row put nearly everything into common buckets, so that most links aren't with a pivot."""
    monkeypatch.setattr(minhash, "SALT_ROWS", salt_rows)
    docs = corpus(5)
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=2, bands=40, rows=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {d: c for d, (_, c) in brute(docs, 2).items()}


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    docs = [(None, "a b c"), (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, "A B\tc"), (7, "A B\tc"), (8, long), (9, long + " end"), (10, "a  b c"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as component_id", "2 as kept")
    rows = minhash.near_duplicates(df, size=2).collect()
    assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [1, 2, 3, 4, 4, 6, 6, 8, 8, 6]
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    kept = minhash.drop_near_duplicates(df, size=2)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "None", "1", "2", "3", "4", "6", "8"])
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_with_several_texts_is_one_node(spark):
    docs = [(1, "a b c d"), (2, "a b c d"), (2, "x y z"), (3, "x y z"), (4, "x y z q"), (4, "m n o p"), (5, "m n o p")]
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    x, y = minhash.signature(a, 512, 7), minhash.signature(b, 512, 7)
    assert abs((x == y).mean() - 1 / 3) < 0.08
    assert (minhash.signature(np.concatenate([a, a]), 512, 7) == x).all()


def test_shorter_texts_differ_from_shingles():
    sets = list(minhash.shingle_sets(pa.array(["a", "a b", "b a", "a b c", None, "a a a a"]), 3))
    assert [len(s) for s in sets] == [1, 1, 1, 1, 0, 1]
    assert len({s[0] for s in sets if len(s)}) == 5


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    nodes = list(range(300))
    rng.shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(150)] + [(nodes[200], x) for x in nodes[201:260]] + [(5, 5), (None, 3)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in rows}
    chain, star = nodes[:151], nodes[200:260]
    assert got == {n: min(g) for g in (chain, star) for n in g if n != min(g)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

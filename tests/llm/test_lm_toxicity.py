import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflux.llm import bytewords as bw
from folioflux.llm import lm, toxicity
from folioflux.llm.elias_fano import EliasFano, map_arrays, pack_arrays

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize(("n", "universe"), [(0, 5), (1, 1), (1, 10**6), (1000, 1000), (20000, 10**9), (3000, 4000), (500, 10**15)])
def test_elias_fano(tmp_path, n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n).astype(np.uint64))
    path = tmp_path / "ef"
    path.write_bytes(pack_arrays(EliasFano.of(values, universe).arrays("x") | {"y": np.arange(3, dtype=np.uint16)}))
    arrays = map_arrays(str(path))
    ef = EliasFano.from_arrays(arrays, "x")
    assert arrays["y"].tolist() == [0, 1, 2] and (ef.get(np.arange(n)) == values).all()
    asked = np.concatenate([rng.integers(0, universe + 3, 2000).astype(np.uint64), values[:500]])
    at, equal = ef.successor(asked)
    assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def model(docs, order):
    """Interpolated absolute discounting by plain dictionaries."""
    sequences = [[None, *re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)), None] for t in docs]
    counts = [Counter(w for s in sequences for w in s[1:])]
    for k in range(2, order + 1):
        counts.append(Counter(tuple(s[i - k + 1 : i + 1]) for s in sequences for i in range(max(1, k - 1), len(s))))
    kept = [None, *[{g for g, n in c.items() if n >= lm.LEAST} for c in counts[1:]]]
    for k in range(2, order):  # a longer n-gram is kept only after a kept one
        kept[k] = {g for g in kept[k] if g[:-1] in kept[k - 1]}
    total, distinct = sum(counts[0].values()), len(counts[0])
    before = lambda k, c: counts[0][c[0]] if k == 1 else counts[k - 1][c]
    rest = [None, *[defaultdict(lambda: 1.0) for _ in kept[1:]]]
    for k in range(1, order):
        for g in kept[k]:
            rest[k][g[:-1]] -= (counts[k][g] - lm.DISCOUNT) / before(k, g[:-1])

    def score(text):
        s = [None, *re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW)), None]
        base = known = out = 0.0
        for i in range(1, len(s)):
            base += math.log10((counts[0][s[i]] + 1) / (total + distinct + 1))
            known += counts[0][s[i]] > 0
            p = (max(counts[0][s[i]] - lm.DISCOUNT, 0) + lm.DISCOUNT * distinct / (distinct + 1)) / total
            for k in range(1, order):
                if i - k < 0:
                    break
                c = tuple(s[i - k : i])
                if (counts[0][c[0]] == 0) if k == 1 else c not in kept[k - 1]:
                    break
                p = (max(counts[k][*c, s[i]] - lm.DISCOUNT, 0) / before(k, c) if (*c, s[i]) in kept[k] else 0) + rest[k][c] * p
            out += math.log10(p)
        return len(s) - 1, int(known), base, out

    return total, score


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("part_tokens", [lm.PART_TOKENS, 40])
def test_scores_are_those_of_dictionaries(spark, monkeypatch, order, part_tokens):
    monkeypatch.setattr(lm, "RUN_TOKENS", 500)
    rng = random.Random(order)
    vocabulary = ["the", "of", "And", "end.", "é", "x1", *[f"w{i}" for i in range(60)]]
    weights = [30, 20, 10, 5, 3, 3, *[1] * 60]
    text = lambda: " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60)))
    docs = [text() for _ in range(150)] + [None, "", "alone"]
    trie = lm.train(spark.createDataFrame([(t,) for t in docs], "text string"), order=order, part_tokens=part_tokens)
    total, score = model(docs, order)
    assert trie.total == total and len(trie.levels) == order
    if part_tokens == 40:
        assert all(level.parts > 3 for level in trie.levels[:2])
    asked = [(i, t, "x") for i, t in enumerate([*docs[:40], text() + " unseen words here", None, "", "THE of"])]
    for r in lm.score(spark.createDataFrame(asked, "doc_id long, text string, lm string"), trie).collect():
        n, known, base, out = score(r["text"])
        assert (r["lm"]["n_tokens"], r["lm"]["n_known"]) == (n, known)
        assert r["lm"]["base_score"] == pytest.approx(base, abs=1e-9) and r["lm"]["score"] == pytest.approx(out, abs=2e-4 * n * order)


def test_ngrams_that_occur_once_are_kept(spark):
    rng = random.Random(7)
    docs = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(40)]
    sequences = [["", *d.split(), ""] for d in docs]
    trie = lm.train(spark.createDataFrame([(d,) for d in docs], "text string"))
    for k in (2, 3):
        distinct = {tuple(s[i - k + 1 : i + 1]) for s in sequences for i in range(k - 1, len(s))}
        assert trie.levels[k - 1].n == len(distinct)
    shared, shuffled = docs[3].split()[10:40], docs[3].split()[10:40]
    rng.shuffle(shuffled)
    rows = lm.score(spark.createDataFrame([(" ".join(shared),), (" ".join(shuffled),)], "text string"), trie).collect()
    found = {r["text"]: r["lm"]["score"] for r in rows}
    assert found[" ".join(shared)] > found[" ".join(shuffled)] + 25


def test_lm_without_training_text(spark):
    trie = lm.train(spark.createDataFrame([], "text string"))
    assert trie.total == 0
    rows = lm.score(spark.createDataFrame([("a b",), (None,)], "text string"), trie).collect()
    assert [(r["lm"]["n_tokens"], r["lm"]["n_known"], r["lm"]["base_score"]) for r in rows] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert lm.score(spark.createDataFrame([], "text string"), trie).count() == 0


# ---- toxicity

BAD = ["grumblefax", "snorklewort", "blatherskite", "vexmonger"]


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "the", "on", "ing", "er", "tion", "of", "re", "st", "la"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randrange(3, 7)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = toxic_corpus(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = docs.where(toxicity.learnable(docs.doc_id))
    m = toxicity.train(known, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    seen = {r["doc_id"] for r in known.collect()}
    found = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score(docs, m).collect()}
    held = [(found[i], y) for i, _, y in rows if i not in seen]
    assert len(held) > 150
    assert np.mean([s >= 0.3 for s, y in held if y]) > 0.9 and np.mean([s >= 0.3 for s, y in held if not y]) < 0.05


def phrase_corpus(n, seed):
    """Toxic texts hold one of six phrases of ordinary words; all their words are as frequent in ordinary texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}q" for i in range(400)]
    phrases = [rng.sample(vocabulary[20:200], rng.randrange(3, 6)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = rng.choices(vocabulary, [1 / (k + 5) for k in range(400)], k=rng.randrange(60, 400))
        for _ in range(rng.randrange(3, 8)):
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(phrases) if i % 6 == 0 else rng.sample(vocabulary[20:200], 4)
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    return rows


def area(scores, labels):
    """The chance that a toxic text scores above an ordinary one."""
    toxic, ordinary = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return np.mean([(a > b) + (a == b) / 2 for a in toxic for b in ordinary])


@pytest.mark.parametrize("n", [400, 1200])
def test_held_out_accuracy_on_phrases_of_ordinary_words(spark, n):
    rows = phrase_corpus(n, n)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = docs.where(toxicity.learnable(docs.doc_id))
    m = toxicity.train(known, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    seen = {r["doc_id"] for r in known.collect()}
    found = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score(docs, m).collect()}
    held = [(found[i], y) for i, _, y in rows if i not in seen]
    assert area(*zip(*held, strict=True)) > 0.95 and np.mean([s >= 0.3 for s, y in held if y]) > 0.8


def test_dictionaries_are_trained_on_whole_texts_of_their_class(spark):
    code = lambda w: toxicity.coded(bw.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), bw.ALPHANUMERIC)[0])
    rows = toxic_corpus(600, 9)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    seen = [Counter(w for _, t, y in rows if y == label for w in t.split()) for label in (0, 1)]
    common = [w for w, n in seen[0].items() if n >= 20 and seen[1][w] >= 5]
    for toxic, ordinary in zip(m.toxic, m.ordinary, strict=True):
        assert toxic[:4] == ordinary[:4] == b"\x37\xa4\x30\xec"  # trained dictionaries, with their tables
        # both hold what is frequent in both; segments aren't aligned with words, so a small dictionary has some only in parts
        assert np.mean([code(w) in toxic for w in common]) > 0.7 and np.mean([code(w) in ordinary for w in common]) > 0.95
    assert all(code(w) in m.toxic[0] and code(w) not in m.ordinary[0] for w in BAD)


def test_long_texts_are_learned_from(spark):
    rng = random.Random(4)
    rows = [(i, t if not y else t + " an the of" * 2000 + " " + " ".join(rng.choices(BAD, k=6)), y) for i, t, y in toxic_corpus(150, 4)]
    assert all(len(t) > 16 << 10 for _, t, y in rows if y)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    short = spark.createDataFrame([("an the of " * 2000 + " ".join(BAD),), ("an the of " * 2000 + "ing er tion re",)], "text string")
    found = {r["text"][-4:]: r["toxicity_score"] for r in toxicity.score(short, m).collect()}
    assert found["nger"] > found["n re"]


def test_only_long_labelled_texts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["an", "the", "of", "ing", "re"] + BAD * y, k=8000)), y) for i in range(20) for y in [i % 2]]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    found = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score(docs, m).collect()}
    assert min(found[i] for i in range(1, 20, 2)) > max(found[i] for i in range(0, 20, 2))


def test_pieces_are_from_all_over_texts():
    texts = [np.random.default_rng(i).integers(0, 1 << 63, 4000).astype(np.uint64) for i in range(30)]
    every, some = toxicity.Pieces(), toxicity.Pieces(60)
    for t in [*texts, texts[0]]:
        every.add(t)
        some.add(t)
    assert len(every.sorted()) == 30 * 250 and sum(len(p) for p in every.held.values()) == 30 * 4000 * 8
    where = {t[a : a + toxicity.PIECE_WORDS].tobytes(): a for t in texts for a in range(0, 4000, toxicity.PIECE_WORDS)}
    places = [where[some.held[mark]] for mark in some.sorted()]
    assert some.sorted() == every.sorted()[:60] and min(places) < 1000 and max(places) > 3000


def test_windows_are_all_runs_of_words():
    bounds = np.array([0, 0, 2, 7, 7, 10])
    for size in (1, 2, 3, 8):
        row, first, sizes = toxicity._windows(bounds, size)
        wanted = []
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            wanted += [(i, s, min(size, b - a)) for s in range(a, max(b - size + 1, a + 1))] if b > a else []
        assert list(zip(row.tolist(), first.tolist(), sizes.tolist(), strict=True)) == wanted


def test_lengths_are_those_of_each_window_alone(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    rng = np.random.default_rng(1)
    words = rng.integers(0, 40, 500).astype(np.uint64)
    pair = tuple(toxicity._compressor(toxicity.coded(np.arange(n, dtype=np.uint64)), toxicity.SCALES[1][-1]) for n in (20, 30))
    _, first, sizes = toxicity._windows(np.array([0, 100, 101, 500]), 3)
    for at, n, less in zip(first, sizes, toxicity.Scorer._shorter(pair, words, first, sizes), strict=True):
        toxic, ordinary = (len(c.compress(toxicity.coded(words[at : at + n]))) for c in pair)
        assert less == (max(ordinary - toxic, 0) if toxic <= toxicity.HELD_BYTES[0] + toxicity.HELD_BYTES[1] * n else 0)


def test_training_sees_no_held_out_label(spark):
    rows = toxic_corpus(200, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = docs.where(toxicity.learnable(docs.doc_id))
    seen = {r["doc_id"] for r in known.collect()}
    one = toxicity.train(known, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    two = toxicity.train(known, spark.createDataFrame([(r[0], r[2] if r[0] in seen else 1 - r[2]) for r in rows], "doc_id long, toxic int"))
    assert one == two


def test_edge_rows(spark):
    rows = toxic_corpus(60, 3)
    docs = [(r[0], r[1]) for r in rows] + [(900, None), (901, ""), (902, " ... "), (903, "an " * 50000), (None, "an the"), (904, "x" * 100000)]
    labels = [(r[0], r[2]) for r in rows] + [(900, 1), (901, None), (902, 0), (902, 1), (903, 0), (None, 1)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, toxicity_score string")
    m = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(df, m).collect()
    assert len(got) == len(docs) and all(0 <= r["toxicity_score"] <= 1 for r in got)
    assert len({r["toxicity_score"] for r in got if not (r["text"] or "").strip(" .")}) == 1
    assert toxicity.score(df.where("false"), m).count() == 0
    for labels in ([], [(1, 0)], [(1, 1)]):
        m = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert len({r["toxicity_score"] for r in toxicity.score(df, m).collect()}) == 1


def test_training_starts_no_plain_python_workers(spark, monkeypatch):
    """Hashes of calibrating rows go to the JVM as Arrow: a list would start workers, and their parent, that no other step uses."""
    from pyspark import SparkContext

    docs = spark.createDataFrame([(i, f"kind plain words number {i} of many" if i % 2 else f"vile nasty slur number {i} of many") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, toxic int")
    docs, labels = docs.localCheckpoint(), labels.localCheckpoint()

    def refuse(*_, **__):
        raise AssertionError("a list of rows goes through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    assert len(toxicity.train(docs, labels).weights) == 14


WASTE = """
import re
from pathlib import Path
import numpy as np, pyarrow as pa
from folioflux.llm import shared, toxicity
taken = lambda: sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024
def learn(batches):
    rng = np.random.default_rng(0)
    for batch in batches:
        samples = [toxicity.coded(rng.integers(0, 1 << 60, 16).astype(np.uint64)) for _ in range(60_000)]
        kept.append(bytearray(1000))  # what lies above freed memory keeps the heap from shrinking by itself
        del samples
        yield batch
kept = []
batch = pa.RecordBatch.from_pydict({"x": [1]})
before = taken()
assert sum(b.num_rows for b in getattr(shared, "lean", lambda f: f)(learn)(iter([batch] * 3))) == 3
print("left", taken() - before)
"""


def test_workers_give_back_what_a_task_has_freed():
    """A worker runs other operators' tasks next: it must not keep the most that any of them took."""
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", WASTE], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split("left")[1]) < 12, done.stdout

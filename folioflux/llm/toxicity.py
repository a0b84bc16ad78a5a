"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, windows of words, calibrated thresholds.

Texts are coded word by word: each word (lower-cased, without punctuation) is 32 bytes that depend on nothing but the word. So what a
compressor matches are whole words and runs of words, and the length of a compressed window says how many of its words and runs a
dictionary doesn't know, without the noise that chance pieces of words make. For each scale (SCALES: single words, and runs of three,
one beginning at each word) one dictionary is trained on the toxic texts and one, separately, on the ordinary texts, and loaded with
its tables. The ordinary one is much larger: what it doesn't hold of that which toxic texts often say, ordinary texts hardly ever
say. Each window is compressed under the toxic dictionary and, where that holds its words, under the ordinary one, and counted by how
many bytes it is shorter under the toxic one.

The labelled rows are dealt by hash: most train the dictionaries, the others (HELD of 10), which no dictionary has seen, calibrate
how many windows beyond which differences make a document toxic, by a logistic function of the counts' logs. Texts are the only
input of a score. Training takes a bounded sample of labelled rows (SAMPLE), whatever their length, and bounded pieces of their
texts (PIECES), drawn by hash from all over them; everything else covers all windows of all whole texts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflux.llm import bytewords as bw
from folioflux.llm.columns import with_text_column
from folioflux.llm.shared import bound_batches, keep, lean, release

#: Labelled rows that training reads at most: toxic and ordinary ones, those of least hash.
SAMPLE = 3000, 6000
#: Of 10 parts of the sample those that calibrate instead of training the dictionaries.
HELD = 2
#: Pieces that a class's dictionaries are trained on at most, drawn by hash from all pieces of all its texts, and their words.
PIECES, PIECE_WORDS = 1 << 16, 16
#: (words of a window, words of a dictionary's segments, bytes of the toxic and of the ordinary dictionary at most, search).
SCALES = (1, 1, 1 << 17, 1 << 22, zstandard.STRATEGY_FAST), (3, 8, 1 << 16, 1 << 22, zstandard.STRATEGY_GREEDY)
#: Windows are counted that are shorter by at least so many bytes; a difference below the least can't come from a whole word.
STEPS = 2, 4, 8, 16, 24
#: A window whose words a dictionary all holds takes at most so many bytes, for its frame and for each word.
HELD_BYTES = 25, 4
#: Words that are coded and compressed at once, and bytes of text that features are taken of at once.
CHUNK, SLICE_BYTES = 1 << 16, 2 << 20

_SALTS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
CODE_BYTES = 8 * len(_SALTS)


def coded(words: np.ndarray) -> bytes:
    """32 bytes for each word."""
    return bw.mix(words[:, None] ^ _SALTS).tobytes()


@dataclass
class Model:
    """For each scale the toxic and the ordinary dictionary, and the logistic function of the features."""

    toxic: list[bytes] = field(default_factory=list)
    ordinary: list[bytes] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)


def _compressor(dictionary: bytes, strategy: int) -> zstandard.ZstdCompressor:
    # all set, as a level stands for another search with every size of dictionary; the tables have a place for every second byte
    places = max(12, len(dictionary).bit_length())
    how = zstandard.ZstdCompressionParameters(
        window_log=max(17, places), hash_log=places - 1, chain_log=places - 1, search_log=3, min_match=6, target_length=0, strategy=strategy, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(compression_params=how)
    own = zstandard.ZstdCompressionDict(dictionary)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how)


def _windows(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and words of all windows of `size` words; a row with fewer words, but not none, is one window."""
    words = np.diff(bounds)
    counts = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(row)) + np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts)
    return row, first, np.minimum(size, words[row])


class Scorer:
    def __init__(self, model: Model):
        self.pairs = [(_compressor(t, scale[-1]), _compressor(o, scale[-1])) for t, o, scale in zip(model.toxic, model.ordinary, SCALES, strict=True)]

    @staticmethod
    def _shorter(pair: tuple, words: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """By how many bytes windows (in order) are shorter under the toxic dictionary; 0 where that doesn't hold all words."""
        toxic, ordinary = pair
        lengths = lambda c, data, at: np.fromiter(map(len, c.multi_compress_to_buffer(zstandard.BufferWithSegments(data, at.tobytes()))), np.int64, len(at))
        out = np.zeros(len(first), np.int64)
        cuts = np.append(np.searchsorted(first, np.arange(0, len(words), CHUNK)), len(first))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                begin = int(first[a])
                data = coded(words[begin : int((first[a:b] + sizes[a:b]).max())])
                places = np.stack([first[a:b] - begin, sizes[a:b]], 1).astype(np.uint64) * np.uint64(CODE_BYTES)
                short = lengths(toxic, data, places)
                held = np.flatnonzero(short <= HELD_BYTES[0] + HELD_BYTES[1] * sizes[a:b])
                if len(held):
                    out[a + held] = np.maximum(lengths(ordinary, data, places[held]) - short[held], 0)
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: the log of its words, and by scale how many windows are shorter by each step (logs), and by how much at most."""
        data, offsets = bw.buffers(texts)
        words, _, bounds = bw.words(data, offsets, bw.ALPHANUMERIC)
        out = [np.log1p(np.diff(bounds))]
        for (size, *_), pair in zip(SCALES, self.pairs, strict=True):
            row, first, sizes = _windows(bounds, size)
            if size == 1:  # equal windows are compressed once
                distinct, back = np.unique(words, return_inverse=True)
                less = self._shorter(pair, distinct, np.arange(len(distinct)), np.ones(len(distinct), np.int64))[back]
            else:
                less = self._shorter(pair, words, first, sizes)
            out += [np.log1p(np.bincount(row[less >= t], minlength=len(texts))) for t in STEPS]
            most = np.zeros(len(texts))
            if len(row):
                begins = np.flatnonzero(np.diff(row, prepend=-1))
                most[row[begins]] = np.maximum.reduceat(less, begins)
            out.append(most)
        return np.stack(out, 1)


class Pieces:
    """Of all distinct pieces of texts, wherever they stand, the `most` of least hash."""

    def __init__(self, most: int = PIECES):
        self.most, self.held, self.below = most, {}, 1 << 64

    def add(self, words: np.ndarray) -> None:
        raw, step = words.tobytes(), 8 * PIECE_WORDS
        for a in range(0, len(raw), step):
            piece = raw[a : a + step]
            mark = xxhash.xxh3_64_intdigest(piece)
            if mark < self.below:
                self.held[mark] = piece
        if len(self.held) > 2 * self.most:
            self.held = {mark: self.held[mark] for mark in self.sorted()}
            self.below = max(self.held)

    def sorted(self) -> list[int]:
        return heapq.nsmallest(self.most, self.held)

    def dictionary(self, size: int, words: int) -> bytes:
        """Trained on the pieces, in the order of their hashes, in segments of so many words; of pieces too few to train on, themselves."""
        samples = [coded(np.frombuffer(self.held[mark], np.uint64)) for mark in self.sorted()]
        try:
            return zstandard.train_dictionary(size, samples, k=words * CODE_BYTES, d=8, f=22, accel=1).as_bytes()
        except (zstandard.ZstdError, ValueError):
            return b"".join(samples)[-size:]


class Distinct:
    """Tells near copies: a text that shares one of four minima over its 5-word shingles with one before."""

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()

    def new(self, h: np.ndarray) -> bool:
        s = h if len(h) < 5 else h[:-4] + 3 * h[1:-3] + 5 * h[2:-2] + 7 * h[3:-1] + 11 * h[4:]
        least = [(j, int(bw.mix(s ^ np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))).min())) for j in range(4)] if len(s) else []
        old = any(x in self.seen for x in least)
        self.seen.update(least)
        return not old


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features, and weights (the last: constant) of a weighted, slightly ridged logistic regression."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1], 1e-3 * weight.sum()), 1e-6]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        gradient = z.T @ (weight * (p - y)) + ridge * w
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def learn(rows: Iterable[tuple[str, int, int]]) -> tuple[list[bytes], list[bytes], list[int]]:
    """From (text, label, hash) in the order of the hashes: toxic and ordinary dictionaries by scale, and hashes of rows to calibrate by.

    Texts are read one at a time. Near copies of a text before neither train nor calibrate. A class of which no row falls to one of the two
    purposes, as it has too few, serves both with all its rows.
    """
    distinct = Distinct()
    pieces = {(label, held): Pieces() for label in (0, 1) for held in (False, True)}
    hashes: dict[tuple[int, bool], list[int]] = {key: [] for key in pieces}
    for text, label, h in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        words, _, _ = bw.words(data, np.array([0, len(data)]), bw.ALPHANUMERIC)
        if distinct.new(words):
            key = label, h % 10 < HELD
            hashes[key].append(h)
            if not key[1] or not hashes[label, False]:  # held texts only as long as a class has nothing else
                pieces[key].add(words)
    training, calibrating = {}, []
    for label in (0, 1):
        train, held = (label, False), (label, True)
        training[label] = pieces[train] if hashes[train] else pieces[held]
        calibrating += hashes[held] if hashes[held] else hashes[train]
    toxic = [training[1].dictionary(most, n) for _, n, most, _, _ in SCALES]
    ordinary = [training[0].dictionary(most, n) for _, n, _, most, _ in SCALES]
    return toxic, ordinary, calibrating


def constant(toxic: int, ordinary: int) -> Model:
    """The model of labels of one class or none: their smoothed mean for every text."""
    share, n = (toxic + 0.5) / (toxic + ordinary + 1), 1 + len(SCALES) * (len(STEPS) + 1)
    return Model([b""] * len(SCALES), [b""] * len(SCALES), [0.0] * n, [1.0] * n, [0.0] * n + [math.log(share / (1 - share))])


def train(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> Model:
    """A model from a bounded sample of documents whose label isn't null; only dictionaries and features of the sample reach the driver.

    The sample is of at most so many toxic and ordinary rows, of any length. Documents and labels meet by id as ids and hashes; only the
    sample's texts are moved. One task reads them one at a time and trains the dictionaries, many tasks take the calibrating texts'
    features. A document with several labels is toxic if one says so; an id with several texts is sampled as each of them. Labels of
    one class, or none, give the same score to every text: their smoothed mean.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col(label) != 0).cast("int")).alias("label"))
    narrow = documents.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    rows = keep(narrow.join(known, "id"), "labelled")
    counts = dict(rows.groupBy("label").count().collect())
    if len(counts) < 2:
        return constant(counts.get(1, 0), counts.get(0, 0))
    parts = [rows.where(F.col("label") == value).orderBy("h", "id").limit(most).select("id", "h", "label") for value, most in ((1, sample[0]), (0, sample[1]))]
    chosen = keep(parts[0].unionByName(parts[1]), "sample")  # at most as many rows as the sample has: broadcast
    texts = documents.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = texts.join(F.broadcast(chosen), ["id", "h"]).select("text", "label", "h")

    def dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t.as_py(), y.as_py(), h.as_py()) for batch in batches for t, y, h in zip(*batch.columns, strict=True))
        toxic, ordinary, held = learn(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((toxic, pa.list_(pa.binary())), (ordinary, pa.list_(pa.binary())), (held, pa.list_(pa.int64())))], ["toxic", "ordinary", "held"])

    one = texts.repartition(1).sortWithinPartitions("h", "label").mapInArrow(lean(dictionaries), "toxic array<binary>, ordinary array<binary>, held array<long>").first()
    model = Model([bytes(x) for x in one[0]], [bytes(x) for x in one[1]])
    held = spark.createDataFrame(pa.table({"h": pa.array(one[2], pa.int64())}))  # a list would start Python workers of another kind
    sent = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in bw.slices(batch, "text", SLICE_BYTES):
                x = scorer.features(part.column(0))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "h", "x"])

    found = sorted(map(tuple, texts.join(F.broadcast(held.distinct()), "h").select("text", "label", "h").mapInArrow(lean(features), "label int, h long, x array<double>").distinct().collect()))
    y = np.array([r[0] for r in found])
    stands_for = np.array([counts[0] / max((y == 0).sum(), 1), counts[1] / max((y == 1).sum(), 1)])
    mean, scale, w = fit_logistic(np.array([r[2] for r in found]), y.astype(float), stands_for[y])
    model.mean, model.scale, model.weights = mean.tolist(), scale.tolist(), w.tolist()
    release()
    return model


def score(documents: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The documents, row by row, with toxicity_score (0 to 1).

    A null text is scored like an empty one. Whole texts are scored, whatever their length; repeated rows get the same score. Other
    columns stay; one named `toxicity_score` is replaced. An empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.Array], pa.Array]:
        m = sent.value
        scorer = Scorer(m)
        mean, scale, w = np.array(m.mean), np.array(m.scale), np.array(m.weights)

        def of(texts: pa.Array) -> pa.Array:
            return pa.array(1 / (1 + np.exp(-np.clip((scorer.features(texts) - mean) / scale @ w[:-1] + w[-1], -35, 35))))

        return of

    return with_text_column(documents, "toxicity_score", T.DoubleType(), text, make, most=SLICE_BYTES)


def learnable(doc_id: Column, modulus: int = 4) -> Column:
    """Rows that models may learn from: crc32 of the id as text leaves another remainder than 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus != 2, F.lit(True))

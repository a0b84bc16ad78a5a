"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: a bijection of 64 bits places a shingle among 2**22 positions, and one permutation of
the positions, circularly shifted by k, gives its value for coordinate k. So the values of one shingle for all coordinates are
neighbours in memory, and a document's signature is the minimum of such rows.

1. One pass over the texts keeps for each document the size and a digest of its shingle set, and its band keys (no texts, no sets).
2. Documents with equal sets are linked by an aggregate on the digest; only the one with the least id goes on.
3. In each bucket of equal band keys every member is paired with the pivot: the member that shares most buckets with others, as the
   original of many copies does. Pairs are linear in the members, and those of one cluster mostly coincide over the bands.
4. All these pairs are verified on full sets, which a second pass makes for members of shared buckets only. Links give components.
5. A bucket that still holds several components may hide links between two members x, y that aren't the pivot o. With c = |x & o|
   known for every member, |x & y| = |x & y & o| + |shingles beyond o that both have| <= min(c) + shared ones. So x, y can only be
   linked if min(c) alone is enough, which needs a y clearly smaller than x, or if they share a shingle that o lacks. Both kinds are
   found by equi-joins (on the bucket and a class of sizes; on the pivot and the shingle) and verified; all other pairs are proven
   to be no links. So every pair that shares a bucket is verified, connected or excluded, and no bucket's pairs are ever emitted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm import bytewords as bw
from folioflux.llm.components import components
from folioflux.llm.shared import bound_batches, keep, lean

#: Positions of the circulant permutation.
POSITIONS = 1 << 22
#: A pair at Jaccard 0.8 shares no bucket with a probability of (1 - 0.8**5)**40 = 1.3e-7.
BANDS, ROWS = 40, 5
#: Sizes of sets within a factor of this are one class.
SIZE_CLASS = 1.05
#: Above so many rows a side is joined by a shuffle, not broadcast.
MAX_BROADCAST_ROWS = 200_000
#: Rows of one key that one task of a join handles; the key's one row on the other side is repeated for every so many.
SALT_ROWS = 1000

_SECOND = np.uint64(0xD6E8FEB86659FD93)
_TABLE: dict[tuple[int, int], np.ndarray] = {}


def shingle_sets(texts: pa.Array, size: int = 2) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `size`-word shingles; of its whole word sequence, if it has fewer words."""
    data, offsets = bw.buffers(texts)
    h, _, bounds = bw.words(data, offsets, bw.BLANK_SEPARATED)
    whole = h
    shingles = h
    for _ in range(size - 1):  # shingles[i] combines words i to i + j
        whole = whole[1:]
        shingles = bw.mix(shingles[: len(whole)] * _SECOND + whole)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(shingles[a : b - size + 1])
        elif b > a:
            short = h[a : a + 1]
            for i in range(a + 1, b):
                short = bw.mix(short * _SECOND + h[i : i + 1])
            yield bw.mix(short ^ np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def circulant(coordinates: int, seed: int) -> np.ndarray:
    """Row p: the values of position p for all coordinates, a view of the permutation that overlaps with the next rows."""
    if (coordinates, seed) not in _TABLE:
        permutation = np.random.Generator(np.random.PCG64(seed)).permutation(POSITIONS).astype(np.uint32)
        _TABLE[coordinates, seed] = np.lib.stride_tricks.sliding_window_view(np.concatenate([permutation, permutation[: coordinates - 1]]), coordinates)
    return _TABLE[coordinates, seed]


def signature(shingles: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    table = circulant(coordinates, seed)
    at = (bw.mix(shingles ^ np.uint64(seed)) >> np.uint64(64 - (POSITIONS.bit_length() - 1))).astype(np.int64)
    out = table[at[:2048]].min(0)
    for i in range(2048, len(at), 2048):
        out = np.minimum(out, table[at[i : i + 2048]].min(0))
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = bw.mix(key * _SECOND + rows[:, j])
    return key.view(np.int64)


def _features(documents: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int, seed: int) -> DataFrame:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch, "text"):
                counts, digests, keys = [], [], []
                for s in shingle_sets(part.column(1), size):
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(band_keys(signature(s, bands * rows, seed), bands) if len(s) else np.empty(0, np.int64))
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), np.concatenate(keys) if keys else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(features), "doc_id long, n_shingles long, digest binary, bands array<long>")


def _sets(documents: DataFrame, doc_id: str, text: str, size: int, wanted: DataFrame, n_wanted: int, *, repeats: bool) -> DataFrame:
    """(node, shingles): the full sets, as bytes, of the wanted documents (node, digest)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bw.slices(batch, "text"):
                blobs = [s.tobytes() for s in shingle_sets(part.column(1), size)]
                digests = [hashlib.blake2b(x, digest_size=16).digest() for x in blobs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], ["node", "digest", "shingles"])

    texts = documents.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    ids = wanted.select("node")
    found = texts.join(F.broadcast(ids) if n_wanted <= MAX_BROADCAST_ROWS else ids, "node", "left_semi").mapInArrow(lean(sets), "node long, digest binary, shingles binary")
    # of rows that repeat an id only the one whose set the node stands for, and that once
    return found.join(wanted, ["node", "digest"], "left_semi").groupBy("node", "digest").agg(F.any_value("shingles").alias("shingles")).drop("digest") if repeats else found.drop("digest")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with n_a, n_b and common: the sizes of their sets and of the intersection."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2), batch.column(3)
            out = np.empty((3, batch.num_rows), np.int64)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(one[i].as_buffer(), np.uint64), np.frombuffer(two[i].as_buffer(), np.uint64)
                out[:, i] = len(x), len(y), int(_among(x, y).sum() if len(x) <= len(y) else _among(y, x).sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], ["a", "b", "n_a", "n_b", "common"])

    return _with_sets(pairs, sets).mapInArrow(lean(compare), "a long, b long, n_a long, n_b long, common long")


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted, non-empty y."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x


def _beyond(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """For pairs (a, b) a row (a, b, extra, shingle) for each of the `extra` shingles of b that a lacks."""

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, one, two = batch.columns
            more = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(one[i].as_buffer(), np.uint64), np.frombuffer(two[i].as_buffer(), np.uint64)
                more.append(y[~_among(y, x)].view(np.int64))
            counts = np.array([len(m) for m in more], np.int64)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            shingles = np.concatenate(more) if more else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows), pa.array(np.repeat(counts, counts)), pa.array(shingles)], ["a", "b", "extra", "shingle"])

    return _with_sets(pairs, sets).mapInArrow(lean(beyond), "a long, b long, extra long, shingle long")


def _salts(rows: str) -> Column:
    return F.ceil(F.col(rows) / SALT_ROWS)


def _dealt(many: DataFrame, by: str, rows: str) -> DataFrame:
    """Adds salt: the number of the task, of as many as the key's `rows` ask for, that a row goes to by its column `by`."""
    return many.withColumn("salt", F.pmod(F.xxhash64(by), _salts(rows)))


def _repeated(one: DataFrame, rows: str) -> DataFrame:
    """The one row of a key for each salt."""
    return one.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), _salts(rows) - 1)))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with both sets. A pivot is the first of any number of pairs: those are dealt over tasks, its set is repeated for each."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("rows"))
    counted = pairs.select("a", "b").join(counts.where(F.col("rows") > SALT_ROWS), "a", "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
    first = _repeated(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(counts, "a"), "rows").drop("rows")
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # the second set first: what is dealt by pivots then has its whole size
    return _dealt(counted, "b", "rows").join(second, "b").join(first, ["a", "salt"]).select("a", "b", "x", "y")


def _hidden_pairs(members: DataFrame, compared: DataFrame, labels: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of one bucket and different components, none of them its pivot, that can be links by step 5."""
    above, below = similarity
    enough = lambda common, n, m: F.lit(above + below) * common >= F.lit(above) * (n + m)
    labelled = members.where("n > 2").select("key", "node", "pivot", F.col("n").alias("rows")).join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_keys = _repeated(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.any_value("rows").alias("rows")).where("low <> high"), "rows").select("key", "salt")
    known = compared.select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.col("n_b").alias("n"), F.col("common").alias("c"))
    opened = _dealt(labelled, "node", "rows").join(open_keys, ["key", "salt"], "left_semi").drop("rows", "salt")
    rows = keep(opened.join(known, ["pivot", "node"]), "open")
    # min(c) alone is enough: for the smaller (or equal) y at least twice its size is needed, which few but those linked to o have
    size_class = lambda n: F.floor(F.log(n) / math.log(SIZE_CLASS)).cast("int")
    index = rows.where(enough(F.col("c"), F.col("n"), F.col("n"))).select("key", F.col("node").alias("b"), F.col("label").alias("other"), F.col("n").alias("m"), F.col("c").alias("d"), size_class(F.col("n")).alias("class"))
    most = F.least(F.col("n"), F.floor(F.lit((above + below) / above) * F.col("c") - F.col("n")) + 1)
    least = F.floor(F.col("n") * (above / below))
    probe = rows.select("key", F.col("node").alias("a"), "label", "n", "c", most.alias("most"), F.greatest(least, F.lit(1)).alias("least")).where("most >= least")
    probe = probe.withColumn("class", F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))))
    sized = probe.join(index, ["key", "class"]).where((F.col("m") <= F.col("n")) & (F.col("label") != F.col("other")) & enough(F.least("c", "d"), F.col("n"), F.col("m"))).select("a", "b")
    # a shingle that the pivot lacks is shared
    of_pivot = rows.select("pivot", "node", "label", "n", "c").distinct()
    beyond = _beyond(of_pivot.select(F.col("pivot").alias("a"), F.col("node").alias("b")), sets).select(F.col("a").alias("pivot"), F.col("b").alias("node"), "extra", "shingle")
    beyond = keep(beyond.join(of_pivot, ["pivot", "node"]).where(enough(F.col("c") + F.col("extra"), F.col("n"), F.col("n") * (above / below))), "beyond")
    several = beyond.groupBy("pivot", "shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("often")).where("low <> high").select("pivot", "shingle", "often")
    # in one order, rarest first, a pair meets first at a place with as many such shingles left on both sides as it can share at most
    of_node = Window.partitionBy("pivot", "node")
    left = F.count("*").over(of_node) - F.row_number().over(of_node.orderBy("often", "shingle")) + 1
    shared = beyond.join(several, ["pivot", "shingle"]).withColumn("left", left).where(enough(F.col("c") + F.col("left"), F.col("n"), F.col("n") * (above / below)))
    shared = keep(shared.select("pivot", "shingle", "node", "label", "n", "c", "left"), "shared")
    other = shared.select("pivot", "shingle", F.col("node").alias("b"), F.col("label").alias("other"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("left").alias("more"))
    both = shared.withColumnRenamed("node", "a").join(other, ["pivot", "shingle"]).where((F.col("a") < F.col("b")) & (F.col("label") != F.col("other")) & enough(F.least("c", "d") + F.least("left", "more"), F.col("n"), F.col("m"))).select("a", "b")
    return sized.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(both).distinct()


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (least id reachable over links), kept (it is that document).

    Documents are linked if their sets of `size`-word shingles reach the Jaccard similarity (a fraction of whole numbers). With fewer
    words the whole sequence is the one shingle. A null or empty text, or one without words, has no shingles and is linked with
    nothing. A null id is linked with nothing, has a null component and is kept. Rows that repeat an id are one node: equal ones
    share a component, and rows of one id with different texts connect what both are linked to. Very long texts are read whole. An
    empty table gives no rows. Other columns take no part.
    """
    bound_batches(documents.sparkSession)
    above, below = similarity
    features = keep(_features(documents, doc_id, text, size, bands, rows, seed), "features")
    full = features.where("digest is not null and doc_id is not null")
    nodes = keep(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands")), "nodes")
    buckets = nodes.select(F.explode("bands").alias("key"), "node")
    shared = keep(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = keep(buckets.join(F.broadcast(shared) if shared.count() <= MAX_BROADCAST_ROWS else shared, "key"), "members")
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighted = members.join(weights, "node")
    pivots = weighted.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("less"))).alias("p"), F.any_value("n").alias("n")).select("key", (-F.col("p.less")).alias("pivot"), "n")
    members = keep(_dealt(members, "node", "n").join(_repeated(pivots, "n").drop("n"), ["key", "salt"]).drop("salt"), "members")
    pairs = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    wanted = keep(nodes.select("node", "digest").join(weights.select("node"), "node", "left_semi"), "wanted")
    repeated = keep(full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    repeats = repeated.limit(1).count() > 0
    sets = keep(_sets(documents, doc_id, text, size, wanted, wanted.count(), repeats=repeats), "sets")
    compared = keep(_compared(pairs, sets), "compared")
    linked = F.lit(below) * F.col("common") >= F.lit(above) * (F.col("n_a") + F.col("n_b") - F.col("common"))
    links = compared.where(linked).select("a", "b")
    if repeats:  # one id with several sets is one node
        of_id = full.join(repeated, "doc_id", "left_semi").join(nodes.select("digest", "node"), "digest")
        links = links.unionByName(keep(of_id.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct(), "same-id"))
    labels = components(links)
    hidden = keep(_hidden_pairs(members, compared, labels, sets, similarity), "hidden")
    more = keep(_compared(hidden, sets).where(linked).select("a", "b"), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    to_component = nodes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    placed = features.select("doc_id", "n_shingles", "digest").join(to_component, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    placed = placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents, all columns as they are, without the rows that near_duplicates() doesn't keep.

    Of equal ids one row stays, whichever; rows with a null id all stay.
    """
    found = keep(near_duplicates(documents, doc_id=doc_id, **how), "near")
    gone = keep(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    out = documents.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone, F.col(doc_id) == F.col("__gone"), "left_anti")
    again = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__again"))
    again = keep(again, "again")
    if again.limit(1).count():
        repeated = out.join(again, F.col(doc_id) == F.col("__again"), "left_semi").dropDuplicates([doc_id])
        out = out.join(again, F.col(doc_id) == F.col("__again"), "left_anti").unionByName(repeated)
    return out

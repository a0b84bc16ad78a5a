"""Exact top-k search by inner product with MaxScore.

The dimensions are terms, a component is a posting's weight. The vectors are dealt once to shards of bounded size, which are written
to the shared folder with their posting lists, term by term, and with each term's least and largest weight there. All queries read
these shards. As weights may be negative, a term's bound in a shard is how much its contribution can exceed its least one there;
every vector has the sum of the least ones as its base.

For a query and a shard, terms are sorted by bound. Those of the longest beginning whose bounds together can't lift a vector from
the base to the query's threshold (its k-th best score so far) are non-essential: a vector needs something of an essential term to
compete. A shard in which all terms together can't is skipped. The essential terms' postings are traversed for the whole shard;
of the other terms, largest bound first, only the postings of vectors that still compete are probed. Tasks keep the k best per query,
and those are merged over all shards by score, then by smaller id. The result is exact: bounds only spare work.

Queries go out in blocks of at most `query_block` vectors, one after the other: a block is broadcast, its results are written, and
the broadcast is dropped, so the driver holds one block at a time however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm.shared import keep

QUERY_BLOCK = 4096
#: Vectors of one shard.
SHARD_ROWS = 4096
#: Non-essential terms that are probed together.
TERM_BLOCK = 4
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53

SHARDS = "size long, ids array<long>, postings binary, low array<long>, high array<long>"
FOUND = "query_id long, vec_id long, score long"


def quantise(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as double; null for vectors that are null or hold null or non-finite components."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def _shard(ids: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
    matrix = np.concatenate(rows)
    names, size = np.concatenate(ids), matrix.shape[1]
    low, high = (matrix.min(0), matrix.max(0)) if size else (np.empty(0, np.int64),) * 2
    columns = [pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(matrix.T).tobytes()], pa.binary()), pa.array([low], pa.list_(pa.int64())), pa.array([high], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["size", "ids", "postings", "low", "high"])


def _sharded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Vectors of one length, up to `most` of them, as a row with postings (weights by term, then by vector) and bounds."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        names, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(offsets)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            matrix = values[offsets[own][:, None] + np.arange(size)] if size else np.empty((len(own), 0), np.int64)
            at = 0
            while at < len(own):
                ids, rows = held.setdefault(size, ([], []))
                n = min(most - sum(map(len, ids)), len(own) - at)
                ids.append(names[own[at : at + n]])
                rows.append(matrix[at : at + n])
                at += n
                if sum(map(len, ids)) == most:
                    yield _shard(*held.pop(size))
    for ids, rows in held.values():
        yield _shard(ids, rows)


def maxscore(query: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, floor: float, k: int, probed: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a shard that can be among the k best with a score of at least `floor`, and their scores.

    postings: a row for each term, over the shard's vectors. `probed` gets, if given, the number of postings that were read of the
    essential terms and of the others.
    """
    a, b = query * low, query * high
    least, bound = np.minimum(a, b), np.abs(b - a)
    base, n = least.sum(), postings.shape[1]
    seen = probed if probed is not None else []
    seen[:] = [0, 0]
    if base + bound.sum() < floor:
        return np.empty(0, np.int64), np.empty(0, postings.dtype)
    order = np.argsort(bound, kind="stable")
    sums = np.cumsum(bound[order])
    split = int(np.searchsorted(sums, floor - base)) if floor > base else 0
    others, essential = order[:split], order[split:]
    seen[0] = len(essential) * n
    score = query[essential] @ (postings[essential] if split else postings[order]) + least[others].sum()  # what each vector has at least
    rows, rest = np.arange(n), bound[others].sum()
    if len(rows) > k:  # k vectors are sure of so much
        floor = max(floor, np.partition(score, n - k)[n - k])
    end = split
    while True:
        competing = score + rest >= floor
        if not competing.all():
            rows, score = rows[competing], score[competing]
        if not end or not len(rows):
            return rows, score
        terms = order[max(end - TERM_BLOCK, 0) : end]
        end -= len(terms)
        seen[1] += len(terms) * len(rows)
        score = score + query[terms] @ postings[np.ix_(terms, rows)] - least[terms].sum()
        rest = bound[order[:end]].sum()
        if len(rows) > k:
            floor = max(floor, np.partition(score, len(rows) - k)[len(rows) - k])


def _numbers(values: np.ndarray, exact: bool) -> np.ndarray:
    """Doubles where all sums are exact in them, else whole numbers of any size."""
    return values.astype(np.float64) if exact else values.astype(object)


def _search(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's shards for each query. queries: by length ids and vectors."""
    best: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for batch in batches:
        for size, ids, postings, low, high in zip(*(c for c in batch.columns), strict=True):
            size = size.as_py()
            if size not in queries:
                continue
            asked, vectors = queries[size]
            names = np.array(ids.values.to_numpy(zero_copy_only=False), np.int64)
            least, most = (np.array(x.values.to_numpy(zero_copy_only=False), np.int64) for x in (low, high))
            whole = np.frombuffer(postings.as_buffer(), np.int64).reshape(size, len(names))
            widest = max(float(np.abs(least.astype(np.float64)).max(initial=0)), float(np.abs(most.astype(np.float64)).max(initial=0)))
            reach = np.abs(vectors.astype(np.float64)).sum(1) * widest
            shard = {exact: [_numbers(x, exact) for x in (whole, least, most)] for exact in {bool(x) for x in reach < EXACT / 4}}
            for i, (query_id, query) in enumerate(zip(asked.tolist(), vectors, strict=True)):
                exact = bool(reach[i] < EXACT / 4)
                heap = best.setdefault((i, size), [])
                # the query's own row may take one of the places
                rows, scores = maxscore(_numbers(query, exact), *shard[exact], -heap[-1][0] if len(heap) == k else -float("inf"), k + 1)
                mine = names[rows]
                other = mine != query_id
                mine, scores = mine[other], scores[other]
                if len(mine) > k:
                    first = np.lexsort((mine, -scores.astype(np.float64)))[:k] if exact else np.array(sorted(range(len(mine)), key=lambda j: (-scores[j], mine[j]))[:k])
                    mine, scores = mine[first], scores[first]
                best[i, size] = sorted([*heap, *((-int(s), n) for s, n in zip(scores.tolist(), mine.tolist(), strict=True))])[:k]
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for (i, size), heap in best.items():
        n = len(heap)
        yield pa.RecordBatch.from_arrays([pa.array([int(queries[size][0][i])] * n, pa.int64()), pa.array([x[1] for x in heap], pa.int64()), pa.array([clamp(-x[0]) for x in heap], pa.int64())], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row that is_query holds for, its k best other rows: query_id, rank (from 1), vec_id, score (long).

    Scores are inner products of floor(scale * component), as whole numbers; one beyond 64 bits becomes the nearest long. Ties go to the
    smaller id. Null ids, null vectors and vectors with null or non-finite components take no part. Vectors meet only vectors of
    their own length; an empty vector scores 0 with the others. Repeated ids: a row never meets rows of its own id; a repeated
    candidate takes a place for each row; a query id that is repeated is answered once for each different vector, merged under the id.
    No rows: no result. Other columns take no part.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantise(F.col(embedding), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id is not null and v is not null")
    shards = keep(clean.select("vec_id", "v").mapInArrow(lambda batches: _sharded(batches, shard_rows), SHARDS), "shards")
    asked = clean.where("q").select("vec_id", "v").distinct()
    blocks = max(1, -(-asked.count() // query_block))
    asked = keep(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")), "asked", by="block")
    found = []
    for block in range(blocks):
        queries: dict[int, tuple[list, list]] = {}
        for r in asked.where(F.col("block") == block).collect():  # about query_block of them
            names, rows = queries.setdefault(len(r["v"]), ([], []))
            names.append(r["vec_id"])
            rows.append(r["v"])
        sent = spark.sparkContext.broadcast({n: (np.array(names, np.int64), np.array(rows, np.int64).reshape(len(rows), n)) for n, (names, rows) in queries.items()})
        found.append(keep(shards.mapInArrow(lambda batches, sent=sent: _search(batches, sent.value, k), FOUND), "found"))
        sent.unpersist()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    merged = reduce(DataFrame.unionByName, found)
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

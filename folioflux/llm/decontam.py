"""Benchmark decontamination: a broadcast set of hashed benchmark n-grams against every window of every training document.

Words are runs of [0-9a-z] and of characters beyond ASCII, after A-Z are lower-cased. A window is `n` consecutive words of a
benchmark item; an item with fewer, but not none, is one window. Document windows whose hash is in the set are verified word by
word; then the words they cover can be cut from the text, or the document dropped.

The set is broadcast in blocks of at most MAX_BLOCK_BYTES of benchmark text, so what is sent at once has a bound. A larger benchmark
takes more passes over the documents, one after the other, and gives the same result: each pass writes what it found and drops its
block before the next one is read, and the findings of the passes are merged at the end. Texts are never shuffled by one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflux.llm import bytewords as bw
from folioflux.llm.columns import with_text_column
from folioflux.llm.shared import keep

MAX_BLOCK_BYTES = 16 << 20

SPAN = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("first_byte", T.LongType()), T.StructField("end_byte", T.LongType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(SPAN))])


def _norm(raw: bytes) -> list[bytes]:
    return raw.translate(_SPACED).split()


_SPACED = bytes(b if b else 0x20 for b in bw.ALPHANUMERIC.tolist())


class Windows:
    """The windows of one block of benchmark items: by length their sorted hashes, what words they are and whose."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        by_words: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            found = _norm((text or "").encode())
            size = min(n, len(found))
            for i in range(len(found) - size + 1 if size else 0):
                by_words.setdefault(tuple(found[i : i + size]), set()).update([] if item is None else [item])
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[tuple[bytes, ...], list[str]]]]] = {}
        for size in sorted({len(w) for w in by_words}):
            own = [(w, sorted(ids)) for w, ids in by_words.items() if len(w) == size]
            data = b" ".join(b" ".join(w) for w, _ in own)
            h, _, _ = bw.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), bw.ALPHANUMERIC)
            hashes = window_hashes(h, size)[::size]
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[hashes & np.uint64((1 << 20) - 1)] = True
            self.lengths[size] = hashes[order], seen, [own[i] for i in order]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` consecutive words."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    if size == 1:
        return bw.mix(h)
    up, down = bw.powers(max(bw.SEGMENT, len(h) + 1))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return bw.mix((sums[size:] - sums[:-size]) * down[: len(h) - size + 1])


def scan_batch(texts: pa.Array, index: Windows) -> tuple[np.ndarray, dict[int, tuple[set[str], list[tuple[int, int, int, int]]]]]:
    """Words of each row, and for rows with hits the items and the covered spans (first word, words, first byte, end byte)."""
    data, offsets = bw.buffers(texts)
    h, begins, bounds = bw.words(data, offsets, bw.ALPHANUMERIC)
    marks: dict[int, tuple[set[str], list[tuple[int, int]]]] = {}
    for size, (hashes, seen, own) in index.lengths.items():
        w = window_hashes(h, size)
        maybe = np.flatnonzero(seen[w & np.uint64(len(seen) - 1)])
        at = np.searchsorted(hashes, w[maybe])
        found = at < len(hashes)
        found[found] = hashes[at[found]] == w[maybe[found]]
        maybe = maybe[found]
        rows = np.searchsorted(bounds, maybe, "right") - 1
        whole = maybe + size <= bounds[rows + 1]
        for i, row in zip(maybe[whole].tolist(), rows[whole].tolist(), strict=True):
            end = int(begins[i + size]) if i + size < bounds[row + 1] else int(offsets[row + 1])
            real = tuple(_norm(data[begins[i] : end].tobytes()))
            k = int(np.searchsorted(hashes, w[i]))
            while k < len(hashes) and hashes[k] == w[i]:
                if own[k][0] == real:
                    items, spans = marks.setdefault(row, (set(), []))
                    items.update(own[k][1])
                    spans.append((i, i + size))
                k += 1
    out = {}
    for row, (items, spans) in marks.items():
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        places = []
        for a, b in merged:
            stop = int(begins[b]) if b < bounds[row + 1] else int(offsets[row + 1])
            last = data[begins[b - 1] : stop]
            gap = np.flatnonzero(bw.ALPHANUMERIC[last] == 0)
            end = int(begins[b - 1]) + (int(gap[0]) if len(gap) else len(last))
            places.append((a - int(bounds[row]), b - a, int(begins[a] - offsets[row]), end - int(offsets[row])))
        out[row] = items, places
    return np.diff(bounds), out


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, cut_spans: bool = False, block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The documents, row by row, with `contamination`: struct of n_words, n_hit (words inside any occurrence of a window), items (ids
    as strings, distinct and sorted, of items with occurring windows) and spans (covered words and bytes, merged).

    A null or empty text has no words and no hits and stays null or empty. An item with a null id marks words but is not listed; null
    or empty items have no windows. Repeated rows and items count each, ids once. Very long texts are read whole, in vector operations
    over bounded segments. With `cut_spans` the covered spans are cut from `text`. Other columns stay; one named `contamination` is
    replaced. An empty benchmark finds nothing.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if total <= block_bytes:
        out = _one_pass(documents, "contamination", text, items, n)[0]
    else:
        out = _passes(documents, text, items, n, -(-total // block_bytes))
    if not cut_spans:
        return out
    raw = F.col(text).cast("binary")
    # what lies between the spans: from the end of one to the beginning of the next
    spans = F.col("contamination.spans")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end_byte"]))
    begins = F.concat(F.transform(spans, lambda s: s["first_byte"]), F.array(F.octet_length(text).cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda p: F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")).cast("string"))
    return out.withColumn(text, F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(F.col(text)))


def _one_pass(documents: DataFrame, name: str, text: str, items: DataFrame, n: int) -> tuple[DataFrame, Broadcast]:
    """The documents with what these items find, and the broadcast that it needs."""
    sent = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])  # as much as a block

    def make() -> Callable[[pa.Array], pa.Array]:
        index = Windows(sent.value, n)
        return lambda texts: _scanned(texts, index)

    return with_text_column(documents, name, FOUND, text, make), sent


def _passes(documents: DataFrame, text: str, items: DataFrame, n: int, blocks: int) -> DataFrame:
    """The documents with what all blocks of items find, one pass for each."""
    numbered = keep(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.monotonically_increasing_id().alias("uid")), "documents")
    texts = numbered.select("uid", F.col(f"row.`{text}`").alias("text"))
    items = keep(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")), "items", by="block")
    found = []
    for block in range(blocks):
        hits, sent = _one_pass(texts, "found", "text", items.where(F.col("block") == block).select("id", "text"), n)
        found.append(keep(hits.where("found.n_hit > 0").select("uid", "found"), "found"))
        sent.unpersist()
    counted, _ = _one_pass(texts, "none", "text", items.where("false").select("id", "text"), n)
    hits = reduce(DataFrame.unionByName, found).groupBy("uid").agg(F.collect_list("found").alias("found"))  # one for each block at most
    joined = numbered.join(counted.select("uid", "none").join(hits, "uid", "left"), "uid")
    every = F.coalesce(F.col("found"), F.array().cast(T.ArrayType(FOUND)))
    names = [F.col(f"row.`{c}`") for c in documents.columns if c != "contamination"]
    return joined.select(*names, F.aggregate(every, F.col("none"), _merged).alias("contamination"))


def _merged(one: Column, two: Column) -> Column:
    """What two blocks found: distinct items, and spans that overlap or touch as one."""
    spans = F.array_sort(F.concat(one["spans"], two["spans"]))
    empty = F.filter(one["spans"], lambda s: F.lit(False))

    def grow(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        end = F.greatest(last["first_word"] + last["n_words"], s["first_word"] + s["n_words"])
        whole = F.struct(last["first_word"].alias("first_word"), (end - last["first_word"]).alias("n_words"), last["first_byte"].alias("first_byte"), F.greatest(last["end_byte"], s["end_byte"]).alias("end_byte"))
        touches = (F.size(done) > 0) & (s["first_word"] <= last["first_word"] + last["n_words"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(whole))).otherwise(F.concat(done, F.array(s)))

    joined = F.aggregate(spans, empty, grow)
    hit = F.aggregate(joined, F.lit(0).cast("long"), lambda n, s: n + s["n_words"])
    return F.struct(one["n_words"].alias("n_words"), hit.alias("n_hit"), F.array_sort(F.array_union(one["items"], two["items"])).alias("items"), joined.alias("spans"))


def _scanned(texts: pa.Array, index: Windows) -> pa.Array:
    counts, found = scan_batch(texts, index)
    none: tuple[set[str], list] = (set(), [])
    rows = [found.get(i, none) for i in range(len(texts))]
    keys = [f.name for f in SPAN.fields]
    span = pa.struct([(k, pa.int64()) for k in keys])
    columns = [
        pa.array(counts, pa.int64()),
        pa.array([sum(s[1] for s in r[1]) for r in rows], pa.int64()),
        pa.array([sorted(r[0]) for r in rows], pa.list_(pa.string())),
        pa.array([[dict(zip(keys, s, strict=True)) for s in r[1]] for r in rows], pa.list_(span)),
    ]
    return pa.StructArray.from_arrays(columns, ["n_words", "n_hit", "items", "spans"])

"""Best-fit packing by hierarchical residual packing.

Documents become pieces of at most `capacity` tokens. Pieces of full length are sequences of their own. The others are dealt to
nodes of bounded size; each node packs its pieces best-fit, largest first, and emits its nearly full bins. Underfull bins go up the
tree as items: fewer nodes pack them best-fit again, round by round, until one node was enough or a round merged nothing. A bin that
no open bin can join any more, as even the smallest is too large for it, is emitted at once. So no node holds more than about
NODE_ITEMS items at any size of input; token ids are never moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflux.llm import bytewords as bw
from folioflux.llm.shared import bound_batches, keep, lean
from folioflux.llm.tokenizing import ids_of

#: Items that one node packs.
NODE_ITEMS = 50_000
#: Nodes whose underfull bins one node of the next round gets.
FAN_IN = 8
#: A bin is nearly full, and emitted, if it lacks at most capacity / NEARLY tokens.
NEARLY = 256


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of full length but the first, which may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item its bin (the index of the bin's first item) and offset, and for each bin's first item the fill.

    Bins are found by the set of residuals that occur, held as bits: the lowest bit from the item's length on is the best fit.
    """
    n = len(lengths)
    bins, offsets, fill = np.empty(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_bins: dict[int, list[int]] = {}
    present = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = present >> size
        if fits:
            residual = size + (fits & -fits).bit_length() - 1
            here = open_bins[residual]
            b = here.pop()
            if not here:
                present &= ~(1 << residual)
            offsets[i] = fill[b]
        else:
            residual, b = capacity, i
        bins[i] = b
        fill[b] += size
        left = residual - size
        open_bins.setdefault(left, []).append(b)
        present |= 1 << left
    return bins, offsets, fill


def _packed(items: DataFrame, nodes: int, capacity: int, salt: int) -> DataFrame:
    """items (uid, length) -> uid, bin (uid of the bin's first item), offset, and for first items fill (else null)."""

    def pack(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        uid, lengths = table["uid"].to_numpy(), table["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        first = bins == np.arange(len(bins))
        return pa.table({"uid": uid, "bin": uid[bins], "offset": offsets, "fill": pa.array(fill, mask=~first)})

    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(nodes)).alias("node"))
    return dealt.groupBy("node").applyInArrow(pack, "uid long, bin long, offset long, fill long")


def pack_lengths(items: DataFrame, capacity: int, *, node_items: int = NODE_ITEMS) -> DataFrame:
    """Items (uid long, unique; length long, 1 to capacity) to bins: uid, sequence_id, offset. No items give no bins.

    sequence_id is the uid of one item of the bin. Offsets are gapless from 0 in each bin.
    """
    count = items.count()
    nodes = max(1, -(-count // node_items))
    round_no = 0
    state = keep(_packed(items, nodes, capacity, round_no), "pack-0")
    out = state.select("uid", F.col("bin").alias("sequence_id"), "offset")
    bins = state.where("fill is not null").select(F.col("uid"), F.col("fill").alias("length"))
    while True:
        underfull = bins.where(F.col("length") < capacity - capacity // NEARLY)
        smallest = underfull.agg(F.min("length")).first()[0]
        if smallest is None:
            break
        # the smallest itself can join no other if none has room for it
        rising = underfull.where(F.col("length") + smallest <= capacity)
        waiting = rising.count()
        if waiting < 2:
            break
        fewer = max(-(-nodes // FAN_IN), -(-waiting // node_items))
        last = fewer == 1
        round_no += 1
        state = keep(_packed(rising, fewer, capacity, round_no), f"pack-{round_no}")
        merged = state.where("uid <> bin")
        gained = merged.count()
        moves = merged.select(F.col("uid").alias("sequence_id"), F.col("bin").alias("__to"), F.col("offset").alias("__by"))
        if gained:
            out = out.join(moves, "sequence_id", "left").select("uid", F.coalesce("__to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("__by", F.lit(0))).alias("offset"))
        if last or not gained:
            break
        if round_no % 8 == 0:  # rounds that merge little may be many: their joins stay few
            out = keep(out, "pack-out")
        bins = state.where("fill is not null").select("uid", F.col("fill").alias("length"))
        nodes = fewer
    return out


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int, *, text: str = "text", end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: the columns of documents but the text, piece, start, length, ids_crc32 and, with
    `with_ids`, ids (binary, little-endian unsigned 32-bit)."""
    bound_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c not in (text, "piece", "start", "length", "ids_crc32", "ids")]
    fields = [("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64())]
    source = documents.select(*[F.col(f"`{c}`") for c in kept], text)
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, t) for n, t, _ in fields], *([T.StructField("ids", T.BinaryType())] * with_ids)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ids_of(tokenizer_path)
        for batch in batches:
            for part in bw.slices(batch, text):
                rows, out, blobs = [], [], []
                for i, t in enumerate(part.column(len(kept)).to_pylist()):
                    ids = np.append(coder.encode(t or ""), np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                        rows.append(i)
                        raw = ids[start : start + length].tobytes()
                        out.append((k, start, length, zlib.crc32(raw)))
                        if with_ids:
                            blobs.append(raw)
                taken = part.take(pa.array(rows, pa.int64()))
                columns = [taken.column(i) for i in range(len(kept))] + [pa.array([r[j] for r in out], fields[j][2]) for j in range(4)] + ([pa.array(blobs, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(lean(cut), schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, *, capacity: int = 1024, text: str = "text", end_id: int = 2, with_ids: bool = False, node_items: int = NODE_ITEMS) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens, in as few as best fit finds.

    A row for each piece: the columns of documents but the text (one named like an added column is replaced), piece (from 0), start,
    length, ids_crc32, [ids,] sequence_id, offset. A null or empty text is the end id alone. Longer documents are cut without loss: all
    pieces are full but the first. Repeated rows are packed each. Ties between pieces of one length go by a number given when they
    were written. An empty table gives no rows.
    """
    pieces = keep(token_pieces(documents, tokenizer_path, capacity, text=text, end_id=end_id, with_ids=with_ids).withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == capacity
    packed = pack_lengths(pieces.where(~whole).select(F.col("__uid").alias("uid"), "length"), capacity, node_items=node_items)
    rest = pieces.where(~whole).join(packed.withColumnRenamed("uid", "__uid"), "__uid")
    full = pieces.where(whole).withColumns({"sequence_id": F.col("__uid"), "offset": F.lit(0).cast("long")})
    names = [c for c in pieces.columns if c not in ("__uid", "sequence_id", "offset")]
    return full.select(*[F.col(f"`{c}`") for c in names], "sequence_id", "offset").unionByName(rest.select(*[F.col(f"`{c}`") for c in names], "sequence_id", "offset"))

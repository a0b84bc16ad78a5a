"""Sharding by histogram sort, in DataFrame functions only.

Rows are ordered by a key of 128 bits: a hash of the text, then a hash of the id. Byte counts below candidate boundaries of that
key are taken over all rows, round by round; each round looks only inside the cells that still hold a splitter and divides them
further, until every splitter meets the tolerance or its cell cannot be divided. Then the rows are exchanged once.

Equal texts are neighbours and share a shard as long as the tolerance allows it; a larger group of copies is divided by the ids'
hashes, so that one text with a third of all rows still spreads. What comes to the driver is at most about 40 000 counts a round.

Slots number a shard's rows in key order. Tasks number ranges of the key (cells) by themselves, of about CELL_ROWS rows: the first
bits of a hash, and, where a text has more copies than that, its copies in ranges of their ids' hashes, between the rows before and
after it. A cell's first slot is the number of rows in the cells before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.llm.shared import keep

#: Bits of the key that each round adds. Both halves of the key have 64.
WIDTHS = (12, 10, 10, 8, 8, 8, 8) * 2
#: Rows of one shard that one task numbers.
CELL_ROWS = 4096
#: Above so many cells their offsets are joined by a shuffle, not by a broadcast.
MAX_BROADCAST_CELLS = 500_000
_SIGN = -(1 << 63)


def _unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def with_key(df: DataFrame, text: str, key: str, carried: list[str] | None = None) -> DataFrame:
    """size (UTF-8 bytes of the text, none for null, plus 16), text_crc32 (null for null), the key's halves __k1 and __k2, and row.

    row: a struct of the input's columns, or of those `carried`, so that no name of theirs can clash with one here.
    """
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in (df.columns if carried is None else carried)]).alias("row"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.col(text).cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("__k1"), F.xxhash64(key).alias("__k2"),
    )


def _bits(half: Column, used: int) -> Column:
    """The first `used` bits of a half; as the halves compare as signed numbers, their first bit is flipped."""
    return F.lit(0).cast("long") if used == 0 else F.shiftrightunsigned(half.bitwiseXOR(F.lit(_SIGN).cast("long")), 64 - used)


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """For each shard but the first the least key (both halves) that belongs to it.

    `tolerance`: how far the bytes below a splitter may be from their ideal, as a part of one shard's ideal bytes.
    """
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = {k: total * k / shards for k in range(1, shards)}
    allowed = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    # cells that hold a splitter: (bits of the first half, of the second) -> (bytes below the cell, splitters)
    open_cells: dict[tuple[int, int], tuple[int, list[int]]] = {(0, 0): (0, list(targets))}
    used = 0
    for width in WIDTHS:
        if not open_cells or not total:
            break
        one, two = min(used, 64), max(0, used - 64)
        in_first = used < 64
        cell = [_bits(F.col("__k1"), one).alias("a"), _bits(F.col("__k2"), two).alias("b")]
        half, before = (F.col("__k1"), one) if in_first else (F.col("__k2"), two)
        digit = _bits(half, before + width).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("digit")
        rows = keyed.select(*cell, digit, "size")
        if used:
            signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
            rows = rows.where(F.col("a").isin([signed(a) for a, _ in open_cells]))
            if not in_first:
                rows = rows.where(F.col("b").isin([signed(b) for _, b in open_cells]))
        counts: dict[tuple[int, int], dict[int, int]] = {}
        for a, b, d, n in rows.groupBy("a", "b", "digit").agg(F.sum("size").alias("bytes")).collect():
            counts.setdefault((_unsigned(a), _unsigned(b)), {})[d] = n
        following: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for (a, b), (below, wanted) in open_cells.items():
            digits = sorted(counts.get((a, b), {}).items())
            for k in wanted:
                low = below
                for d, n in digits:
                    if low + n >= targets[k] or d == digits[-1][0]:
                        break
                    low += n
                high = low + n
                at = (a << width | d, b) if in_first else (a, b << width | d)
                miss_low, miss_high = abs(targets[k] - low), abs(high - targets[k])
                if min(miss_low, miss_high) <= allowed or used + width == sum(WIDTHS):
                    found[k] = _boundary(at, used + width, after=miss_high < miss_low)
                else:
                    following.setdefault(at, (low, []))[1].append(k)
        open_cells, used = following, used + width
    highest = ((1 << 63) - 1, (1 << 63) - 1)
    return sorted(found.get(k, highest) for k in targets)


def _boundary(cell: tuple[int, int], used: int, *, after: bool) -> tuple[int, int]:
    """The least key of a cell, or the least key after it, as signed halves."""
    whole = (cell[0] << 64 - min(used, 64)) << 64 | (cell[1] << 128 - used if used > 64 else 0)
    if after:
        whole = min(whole + (1 << 128 - used), (1 << 128) - 1)
    return (whole >> 64) + _SIGN, (whole & (1 << 64) - 1) + _SIGN


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted boundaries are not above the key: nested comparisons, a binary search that is compiled."""

    def search(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        k1, k2 = (F.lit(x).cast("long") for x in bounds[m])
        above = (F.col("__k1") > k1) | ((F.col("__k1") == k1) & (F.col("__k2") >= k2))
        return F.when(above, search(m + 1, b)).otherwise(search(a, m))

    return search(0, len(bounds)).cast("int")


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast as long as its counted rows are few."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_CELLS else df


def _with_cell(df: DataFrame, bits: int, hot: DataFrame | None) -> DataFrame:
    """Adds cell: a struct that sorts like the key. hot: (prefix, copies: sorted texts' hashes of that prefix with many rows, and bits)."""
    prefix = _bits(F.col("__k1"), bits)
    if hot is None:
        return df.withColumn("cell", F.struct(prefix.alias("prefix"), F.lit(0).alias("before"), F.lit(False).alias("own"), F.lit(0).cast("long").alias("part")))
    joined = df.withColumn("prefix", prefix).join(hot, "prefix", "left")
    before = F.coalesce(F.size(F.filter("copies", lambda c: c["__k1"] < F.col("__k1"))), F.lit(0))
    mine = F.filter("copies", lambda c: c["__k1"] == F.col("__k1"))
    own = F.coalesce(F.size(mine) > 0, F.lit(False))
    # the first bits of the second half, as many as the copies ask for
    part = F.when(own, F.call_function("shiftrightunsigned", _bits(F.col("__k2"), 32), F.lit(32) - F.element_at(mine, 1)["bits"])).otherwise(F.lit(0)).cast("long")
    return joined.withColumn("cell", F.struct("prefix", F.greatest(before, F.lit(0)).alias("before"), own.alias("own"), part.alias("part"))).drop("prefix", "copies")


def _hot(narrow: DataFrame, bits: int, cell_rows: int) -> DataFrame | None:
    """The texts' hashes with more than cell_rows rows, in arrays by prefix; a prefix has few, as hashes are uniform."""
    crowded = keep(narrow.groupBy(_bits(F.col("__k1"), bits).alias("prefix")).agg(F.count("*").alias("n")).where(F.col("n") > cell_rows), "crowded")
    if not crowded.limit(1).count():
        return None
    rows = narrow.select(_bits(F.col("__k1"), bits).alias("prefix"), "__k1").join(_bounded(crowded.select("prefix")), "prefix", "left_semi")
    often = rows.groupBy("prefix", "__k1").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    width = F.least(F.ceil(F.log2(F.col("n") / cell_rows)), F.lit(31)).cast("int")
    copies = keep(often.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("__k1", width.alias("bits")))).alias("copies")), "copies")
    return _bounded(copies) if copies.limit(1).count() else None


def histogram_shards(df: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", tolerance: float = 0.01, carried: list[str] | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows with size, text_crc32, shard (0 to shards - 1; contiguous in key order) and slot (from 0 in key order, gapless in each shard).

    A null text has size 16, no checksum (null) and a place like any other; a null id is hashed like a value. Rows that are equal in
    text and id share a shard; their order among themselves is any. Empty and very long texts are no special cases: a text longer than
    a shard's share fills it alone, and neighbours may stay small or empty. An empty table gives no rows. Of columns named like an
    added one the added one stays; any other name may occur. `carried`: columns that the result has beside the added ones, all if None.
    """
    keyed = with_key(df, text, key, carried)
    if carried is not None:  # narrow rows are written once; whole ones are read again instead
        keyed = keep(keyed, "sharded")
    narrow = keyed.select("size", "__k1", "__k2") if carried is not None else keep(keyed.select("size", "__k1", "__k2"), "shard-keys")
    shard = shard_of(splitters(narrow, shards, tolerance))
    bits = max(0, (narrow.count() // cell_rows).bit_length())
    hot = _hot(narrow, bits, cell_rows)
    counts = _with_cell(narrow.select(shard.alias("shard"), "__k1", "__k2"), bits, hot).groupBy("shard", "cell").agg(F.count("*").alias("n"))
    running = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keep(counts.select("shard", "cell", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("offset")), "offsets")
    in_cell = Window.partitionBy("shard", "cell").orderBy("__k1", "__k2")
    placed = _with_cell(keyed.withColumn("shard", shard), bits, hot).withColumn("nth", F.row_number().over(in_cell) - 1).join(_bounded(offsets), ["shard", "cell"])
    added = ["size", "text_crc32", "shard", "slot"]
    names = [c for c in (df.columns if carried is None else carried) if c not in added]
    return placed.select(*[F.col(f"row.`{c}`") for c in names], "size", "text_crc32", "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard, rows in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

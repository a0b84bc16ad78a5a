"""Content addresses: sha1 over stripped texts, ordered ids and rendered blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.functions.text import strip


def segment_id(text: Column, chapter_index: Column, position: Column) -> Column:
    return F.sha1(F.concat_ws(":", chapter_index.cast("string"), position.cast("string"), strip(text)).cast("binary"))


def segment_hash(text: Column) -> Column:
    return F.sha1(strip(text).cast("binary"))


def book_hashes(segments: DataFrame) -> DataFrame:
    """(book_key, book_hash, n_segments): sha1 over a book's segment ids in order, one to a line.

    One book's ids must come together, as the hash is over their sequence: 44 bytes a segment.
    """
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"])
    return segments.groupBy("book_key").agg(F.sha1(F.array_join(ids, "\n").cast("binary")).alias("book_hash"), F.count("*").alias("n_segments"))


def prompt_block(terms: Column) -> Column:
    """A map of terms as lines `- term -> rendering` in order of the terms."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(terms)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(" -> "), e["value"])), "\n")


def glossary_identity(terms: Column) -> Column:
    """sha1 of the block; null and empty glossaries have the same identity."""
    return F.sha1(strip(F.coalesce(prompt_block(terms), F.lit(""))).cast("binary"))


def digest(parts: list[Column], length: int = 16) -> Column:
    """The first hex digits of sha1 over the parts, separated by NUL; null parts count as empty."""
    return F.substring(F.sha1(F.concat_ws("\x00", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary")), 1, length)


def catalog_id(path: Column) -> Column:
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)

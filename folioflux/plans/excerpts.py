"""Excerpts that a model is shown once for a book: its opening, or evenly spaced chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflux.functions.text import is_blank, strip
from folioflux.operators.running import running_total


def opening(segments: DataFrame, chars: int) -> DataFrame:
    """(book_key, excerpt): stripped segments with blank lines between, until they have `chars` characters, then cut to that.

    Only segments that begin within the bound are gathered, at most `chars` of them.
    """
    rows = segments.where(~is_blank(F.col("text"))).select("book_key", "position", strip(F.col("text")).alias("text"))
    placed = running_total(rows, ["book_key"], ["position"], F.length("text"), "before").where(F.col("before") < chars)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])
    return placed.groupBy("book_key").agg(F.substring(F.array_join(parts, "\n\n"), 1, chars).alias("excerpt"))


def spaced_chapters(segments: DataFrame, count: int) -> DataFrame:
    """The segments of up to `count` chapters of each book, evenly spaced over those that have text."""
    chapters = segments.where(~is_blank(F.col("text"))).select("book_key", "chapter_index").distinct()
    ranked = chapters.withColumns({"rank": F.row_number().over(Window.partitionBy("book_key").orderBy("chapter_index")) - 1, "n": F.count("*").over(Window.partitionBy("book_key"))})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * F.col("n") / F.least(F.lit(count), F.col("n"))))
    kept = ranked.where((F.col("n") <= count) | F.array_contains(wanted, F.col("rank").cast("long"))).select("book_key", "chapter_index")
    return segments.join(kept, ["book_key", "chapter_index"], "left_semi")

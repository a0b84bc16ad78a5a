"""Segment tables: rows of (book_key, chapter_index, position, text, ...) from text tables, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.functions import identity, text
from folioflux.operators.kept import keep
from folioflux.operators.running import running_totals


def segments_of_lines(documents: DataFrame) -> DataFrame:
    """Each line of each document as a segment: a source is a book, a document a chapter, in order of doc_id.

    type: `other` for blank lines, `list_item` for lines that begin with a dash or star, `heading` for lines of at most six words that
    don't end a sentence, else `paragraph`. The chapter's title is its first line. doc_id is taken to be unique.
    """
    docs = documents.select(F.col("source").alias("book_key"), "doc_id", F.split("text", "\n").alias("lines")).withColumn("n_lines", F.size("lines"))
    counts = keep(docs.select("book_key", "doc_id", "n_lines"), "line-counts")
    placed = running_totals(counts, ["book_key"], ["doc_id"], {"first": F.col("n_lines"), "chapter_index": F.lit(1)})
    rows = docs.join(keep(placed.drop("n_lines"), "chapters"), ["book_key", "doc_id"]).select("book_key", "doc_id", F.col("chapter_index").cast("int"), "first", F.col("lines")[0].alias("chapter_title"), F.posexplode("lines").alias("line_no", "text"))
    t = F.col("text")
    kind = (
        F.when(text.is_blank(t), "other").when(t.rlike(f"^[{text.WS}]*[-*] "), "list_item")
        .when((text.word_count(t) <= 6) & ~t.rlike(rf"[.!?][{text.WS}]*\z"), "heading").otherwise("paragraph")
    )
    rows = rows.withColumn("position", (F.col("first") + F.col("line_no")).cast("long")).withColumn("type", kind)
    level = F.when(F.col("type") == "heading", F.when(F.col("line_no") == 0, 1).otherwise(2))
    out = rows.withColumn("heading_level", level).withColumn("id", identity.segment_id(F.col("text"), F.col("chapter_index"), F.col("position")))
    return out.select("book_key", "chapter_index", "chapter_title", "position", "type", "heading_level", "text", "id", "doc_id")


def inventory(segments: DataFrame) -> DataFrame:
    """Segments by book, with counts by type, chapters and blanks."""
    kinds = ("heading", "paragraph", "list_item", "blockquote", "caption", "other")
    return segments.groupBy("book_key").agg(
        F.count("*").alias("n_segments"), F.countDistinct("chapter_index").alias("n_chapters"), F.count_if(text.is_blank(F.col("text"))).alias("n_blank"),
        *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds], F.sum(text.word_count(F.col("text"))).alias("n_words"),
    )


def flagged_chapters(segments: DataFrame) -> DataFrame:
    """(book_key, chapter_index) of chapters that a title names as front or back matter."""
    title = F.col("chapter_title")
    return segments.where(text.is_front_title(title) | text.is_back_title(title)).select("book_key", "chapter_index").distinct()


def restrict_to_body(items: DataFrame, excluded: DataFrame, sample_size: int) -> DataFrame:
    """Items outside the excluded chapters; all items of a book where fewer than `sample_size` would be left. Adds `restricted`."""
    marked = items.join(excluded.withColumn("__out", F.lit(True)), ["book_key", "chapter_index"], "left")
    left = marked.groupBy("book_key").agg((F.count_if(F.col("__out").isNull()) >= sample_size).alias("restricted"))
    return marked.join(left, "book_key").where(~F.col("restricted") | F.col("__out").isNull()).drop("__out")


def eligible_paragraphs(segments: DataFrame, least_words: int = 15) -> DataFrame:
    """Paragraphs of enough words outside front and back matter, with words, band, strata and hash."""
    body = segments.where((F.col("type") == "paragraph") & (text.word_count(F.col("text")) >= least_words)).join(flagged_chapters(segments), ["book_key", "chapter_index"], "left_anti")
    n = text.word_count(F.col("text"))
    return body.withColumns({"words": n, "band": text.band_of(n), "strata": text.strata_of(F.col("text")), "segment_hash": identity.segment_hash(F.col("text"))})

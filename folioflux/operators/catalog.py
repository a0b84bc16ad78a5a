"""Listings of books: ids, download names, and what tells equal titles apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.functions import identity, text

MAX_STEM = 100
#: fixed value: what file names can't hold
UNSAFE = r'[\x{00}-\x{1F}\x{7F}<>:"/\\|?*]'


def mentions(stem: Column, language: Column) -> Column:
    """Whether the stem holds the language tag as a whole word, in any case."""
    return F.rlike(F.lower(stem), F.concat(F.lit(text.EDGE[0]), F.regexp_replace(F.lower(language), r"([\\.^$|?*+()\[\]{}-])", r"\\$1"), F.lit(text.EDGE[1])))


def download_name(title: Column, language: Column, fallback: Column) -> Column:
    """A safe file name with the language, unless the title has it already."""
    safe = lambda c: F.regexp_replace(c, UNSAFE, "")
    stem = text.collapse(F.regexp_replace(F.regexp_replace(text.strip(safe(title)), r"^\.+", ""), r"\.+\z", ""))
    other = text.strip(safe(fallback))
    stem = F.when(F.length(stem) > 0, stem).when(F.length(other) > 0, other).otherwise("book")
    tagged = F.when((F.length(language) > 0) & ~mentions(stem, language), F.concat(stem, F.lit(" ("), language, F.lit(")"))).otherwise(stem)
    return F.concat(text.strip(F.substring(tagged, 1, MAX_STEM)), F.lit(".epub"))


def listing(books: DataFrame) -> DataFrame:
    """books (path, title, authors, language, size_bytes) with id, author_line, size, download_name and distinguisher.

    Where title and authors occur more than once, in any case, the file's name tells them apart. Order by lower(title) to show them.
    """
    file_stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?\z", 1)
    stem = F.regexp_replace(file_stem, UNSAFE, "")
    line = F.array_join("authors", ", ")
    same = Window.partitionBy(F.lower("title"), F.lower("author_line"))
    rows = books.withColumns({"id": identity.catalog_id(F.col("path")), "author_line": line, "size": text.format_size(F.col("size_bytes")), "download_name": download_name(F.col("title"), F.col("language"), file_stem)})
    rows = rows.withColumn("distinguisher", F.when(F.count("*").over(same) > 1, F.when(F.length(text.strip(stem)) > 0, text.strip(stem)).otherwise(F.col("id"))))
    named = F.concat(F.regexp_replace("download_name", r"\.epub\z", ""), F.lit(" — "), F.col("distinguisher"), F.lit(".epub"))
    return rows.withColumn("download_name", F.when(F.col("distinguisher").isNotNull(), named).otherwise(F.col("download_name")))


def book_word(n: Column) -> Column:
    """The Slovenian noun after a count."""
    r = F.pmod(n, F.lit(100))
    return F.when(r == 1, "knjiga").when(r == 2, "knjigi").when(r.isin(3, 4), "knjige").otherwise("knjig")


def content_disposition(filename: Column) -> Column:
    """An ASCII name and the full one, percent-encoded."""
    plain = F.regexp_replace(filename, r"[^\x{20}-\x{7E}]|[\"\\]", "_")
    return F.concat(F.lit('attachment; filename="'), plain, F.lit("\"; filename*=UTF-8''"), F.replace(F.url_encode(filename), F.lit("+"), F.lit("%20")))


def render_entries(entries: DataFrame, token: str) -> DataFrame:
    """(position, article): the listing's markup, entry by entry, in order of the titles."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    article = F.format_string(
        '<article><h2>%s</h2><p class="authors">%s</p><p class="meta">%s</p><a class="download" href="/book/%s?t=%s" download="%s">Prenesi</a></article>',
        esc(F.col("title")), esc(F.col("author_line")), F.concat_ws(" · ", "size", F.nullif(F.col("language"), F.lit("")), "distinguisher"), F.col("id"), F.lit(token), esc(F.col("download_name")),
    )
    return entries.select(F.row_number().over(Window.orderBy(F.lower("title"), "id")).alias("position"), article.alias("article"))

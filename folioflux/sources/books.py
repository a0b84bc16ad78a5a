"""Books as JSON documents, JSON-lines sinks, and where files are found."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflux.operators.kept import keep
from folioflux.sources import epub

SUFFIXES = (".epub", ".pdf", ".mobi", ".azw3")
_SEGMENTS = "array<struct<id:string,type:string,text:string,chapter_index:int,chapter_title:string,position:bigint,heading_level:int>>"
_IMAGES = "array<struct<id:string,media_type:string,data:string,source_href:string,chapter_index:int,anchor_segment_id:string,alt:string>>"
#: Fields that older documents lack are null.
BOOK_JSON = f"title string, authors array<string>, language string, source_path string, source_format string, segments {_SEGMENTS}, images {_IMAGES}"
_WRITTEN = {"ignoreNullFields": "false"}
#: A piece of a document ends with the element that takes it over so many characters.
PIECE_CHARS = 1 << 20
#: Books are broadcast to their segments up to so many, counted.
MAX_BROADCAST_ROWS = 200_000


def normalize(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, segments, images) of the files at a path. Files that no reader is for are refused with what they need."""
    files = epub.read(spark, path)
    return epub.books(files), epub.segments(files), epub.images(files)


def _segment() -> Column:
    return F.struct("id", "type", "text", "chapter_index", "chapter_title", "position", "heading_level")


def _image() -> Column:
    return F.struct(F.col("image_id").alias("id"), "media_type", F.base64("data").alias("data"), "source_href", "chapter_index", F.col("anchor_id").alias("anchor_segment_id"), "alt")


def _fields(books: DataFrame) -> list[str]:
    return [c for c in ("title", "authors", "language", "source_path", "source_format") if c in books.columns]


def to_json(books: DataFrame, segments: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(book_key, json): each book as one document in a row, segments in order, image bytes in base64. json_pieces is for books of any size."""
    s = F.struct(F.col("position").alias("__at"), _segment().alias("s"))
    own = segments.groupBy("book_key").agg(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["s"]).alias("segments"))
    rows = books.join(own, "book_key", "left")
    if images is None:
        rows = rows.withColumn("images", F.array())
    else:
        rows = rows.join(images.groupBy("book_key").agg(F.array_sort(F.collect_list(_image())).alias("images")), "book_key", "left")
    return rows.select("book_key", F.to_json(F.struct(*_fields(rows), "segments", "images"), _WRITTEN).alias("json"))


def json_pieces(books: DataFrame, segments: DataFrame, images: DataFrame | None = None, *, chars: int = PIECE_CHARS) -> DataFrame:
    """(book_key, piece, part, json): the documents of to_json() in pieces; those of a book, in order of `piece`, make its document.

    No row and no task holds a book: rows are dealt by range and become pieces as they pass. part: 0 what is before the segments, 1
    segments, 2 what is between them and the images, 3 images, 4 the end. A piece ends between two elements. books: one row a book.
    """
    least = F.lit(-(1 << 63)).cast("long")
    place = F.coalesce("position", least)
    own = segments.groupBy("book_key").agg(F.min(place).alias("__segment"))
    rows = books.select("book_key", F.to_json(F.struct(*_fields(books)), _WRITTEN).alias("about")).join(own, "book_key", "left")
    if images is None:
        rows = rows.withColumns({"__some": F.lit(False), "__image": F.lit(None).cast("string"), "__none": F.lit("[]")})
    else:
        named = images.groupBy("book_key").agg(F.lit(True).alias("__some"), F.min(F.coalesce("image_id", F.lit(""))).alias("__image"))
        rows = rows.join(named, "book_key", "left").withColumns({"__some": F.coalesce("__some", F.lit(False)), "__none": F.lit("null")})
    heads = keep(rows, "heads")
    known = heads.select("book_key")
    known = F.broadcast(known) if known.count() <= MAX_BROADCAST_ROWS else known
    # what opens a list has the place of the list's first element, so that it comes in the same range
    some = F.col("__segment").isNotNull()
    opening = F.concat(F.expr("left(about, length(about) - 1)"), F.lit(',"segments":'), F.when(some, "[").otherwise("null"))
    between = F.concat(F.when(some, "]").otherwise(""), F.lit(',"images":'), F.when(F.col("__some"), "[").otherwise(F.col("__none")))
    end = F.when(F.col("__some"), "]}").otherwise("}")
    row = lambda part, group, at, name, own: [F.lit(part).alias("part"), F.lit(group).alias("group"), at.alias("at"), name.alias("name"), own]
    nothing, unnamed = F.lit(None).cast("long"), F.lit(None).cast("string")
    all_rows = heads.select("book_key", *row(0, 1, F.col("__segment"), unnamed, opening.alias("text")))
    all_rows = all_rows.unionByName(heads.select("book_key", *row(2, 3, nothing, F.col("__image"), between.alias("text"))))
    all_rows = all_rows.unionByName(heads.select("book_key", *row(4, 4, nothing, unnamed, end.alias("text"))))
    all_rows = all_rows.unionByName(segments.join(known, "book_key", "left_semi").select("book_key", *row(1, 1, place, unnamed, _segment().alias("segment"))), allowMissingColumns=True)
    if images is not None:
        all_rows = all_rows.unionByName(images.join(known, "book_key", "left_semi").select("book_key", *row(3, 3, nothing, F.coalesce("image_id", F.lit("")), _image().alias("image"))), allowMissingColumns=True)
    dealt = all_rows.repartitionByRange("book_key", "group", "at", "name").sortWithinPartitions("book_key", "group", "at", "name", "part", *[c for c in ("image",) if c in all_rows.columns])
    text = F.coalesce("text", F.to_json("segment", _WRITTEN), *[F.to_json(c, _WRITTEN) for c in ("image",) if c in all_rows.columns])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kind, held, size = None, None, [], 0
        before = None

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([kind], pa.int32()), pa.array(["".join(held)], pa.string())], ["book_key", "part", "json"])

        for batch in batches:
            for k, part, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (k != key or part != kind or size >= chars):
                    yield piece()
                    held, size = [], 0
                # an element that nothing precedes in this task follows another one, as what opens its list would be here
                if part in (1, 3) and before != (k, part - 1):
                    held.append(",")
                key, kind, before = k, part, (k, part)
                held.append(own)
                size += len(own)
        if held:
            yield piece()

    pieces = dealt.select("book_key", "part", text.alias("text")).mapInArrow(cut, "book_key string, part int, json string")
    # ranges are in order, and so are the rows of each
    return pieces.select("book_key", F.monotonically_increasing_id().alias("piece"), "part", "json")


def from_json(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, segments, images) of (book_key, json)."""
    rows = documents.select("book_key", F.from_json("json", BOOK_JSON).alias("b"))
    return _read(rows, rows.select("book_key", F.explode("b.segments").alias("s")), rows.select("book_key", F.explode("b.images").alias("i")))


def from_json_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, segments, images) of what json_pieces() gave: each piece is read by itself, so that no task holds a book."""
    opened = F.concat("json", F.when(F.col("json").endswith("["), "]}").otherwise("}"))
    listed = F.concat(F.lit("["), F.regexp_replace("json", "^,", ""), F.lit("]"))
    elements = lambda part, kind, name: pieces.where(F.col("part") == part).select("book_key", F.explode(F.from_json(listed, kind)).alias(name))
    return _read(pieces.where("part = 0").select("book_key", F.from_json(opened, BOOK_JSON).alias("b")), elements(1, _SEGMENTS, "s"), elements(3, _IMAGES, "i"))


def _read(books: DataFrame, segments: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    about = books.select("book_key", "b.title", "b.authors", "b.language", "b.source_path", "b.source_format")
    pictures = images.select("book_key", F.col("i.id").alias("image_id"), "i.media_type", F.unbase64("i.data").alias("data"), "i.source_href", "i.chapter_index", F.col("i.anchor_segment_id").alias("anchor_id"), "i.alt")
    return about, segments.select("book_key", "s.*"), pictures


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines."""
    rows.write.mode("append").json(path)


def mixed(kinds: dict[str, DataFrame]) -> DataFrame:
    """Rows of several shapes under one schema, told apart by `kind`."""
    out = None
    for kind, rows in kinds.items():
        tagged = rows.withColumn("kind", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def discover_source(translated: str, lang: str, names: list[str]) -> str | None:
    """For `stem.lang.epub` the first of stem with a known suffix that is among the names."""
    stem = PurePosixPath(translated).name.removesuffix(".epub").removesuffix(f".{lang}")
    return next((f"{stem}{s}" for s in SUFFIXES if f"{stem}{s}" in names), None)


def output_path(source: str, lang: str) -> str:
    p = PurePosixPath(source)
    return str(p.with_name(f"{p.stem}.{lang}.epub"))


def load_config(defaults: dict, env_file: str | None = None, prefix: str = "FOLIOFLUX_", **overrides) -> dict:
    """Defaults, then the environment, then a file of KEY=value lines, then overrides that aren't None."""
    out = dict(defaults)
    found = {k: v for k, v in os.environ.items() if k.startswith(prefix)}
    if env_file:
        with open(env_file, encoding="utf-8") as f:
            pairs = [line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
        found |= {k.strip(): v.strip().strip("\"'") for k, v in pairs}
    out |= {k.removeprefix(prefix).lower(): v for k, v in found.items() if k.removeprefix(prefix).lower() in defaults}
    return out | {k: v for k, v in overrides.items() if v is not None}

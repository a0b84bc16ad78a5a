"""Page layout: margins, running heads, paragraphs, chapters and images from positioned lines.

Lines are rows of (book_key, page_index, line_no, text, x0, y0, size, page_height). Per-page work is windows over pages; what needs a
book's lines together is aggregates over their places, without texts. The reflow is a fold over ranges of a book's lines in order; what
is open where ranges meet is joined afterwards. Texts are shuffled by page and by range, once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.functions import identity, text
from folioflux.functions.patterns import clean_text, is_incomplete, joined, opens_lowercase
from folioflux.operators.kept import keep
from folioflux.operators.running import MAX_BROADCAST_ROWS, row_index

# ---- fixed values: shares of a page and of a book, gaps, image sizes -----------------------------------------------------------------
HEADER_SHARE, FOOTER_SHARE = 0.08, 0.92
RUNNING_HEAD_PAGES = 3
INDENT, GAP = 0.8, 1.6
FRONT_SHARE, BACK_SHARE = 0.25, 0.5
BACK_CHAPTER, FRONT_CHAPTER = "Notes", "Front Matter"
DEFAULT_BODY_SIZE = 12.0
LEAST_IMAGE_PIXELS, FULL_PAGE_AREA, SCAN_AREA, SCAN_SHARE, RECURRING_PAGES, CAPTION_LINES = 64, 0.9, 0.5, 0.5, 3, 4


def in_band(y0: Column, page_height: Column) -> Column:
    return (y0 < HEADER_SHARE * page_height) | (y0 > FOOTER_SHARE * page_height)


def ordered_lines(lines: DataFrame) -> DataFrame:
    """Lines with in_band and line_no by their place on the page: from above, then from the left."""
    place = Window.partitionBy("book_key", "page_index").orderBy(F.bround("y0", 1), "x0", "line_no")
    return lines.withColumn("in_band", in_band(F.col("y0"), F.col("page_height"))).withColumn("line_no", (F.row_number().over(place) - 1).cast("int"))


def running_heads(lines: DataFrame) -> DataFrame:
    """(book_key, head_key, n_pages): keys of lines in the margins of three pages or more."""
    keyed = lines.where("in_band").select("book_key", "page_index", text.head_key(F.col("text")).alias("head_key")).where(F.length("head_key") > 0)
    return keyed.groupBy("book_key", "head_key").agg(F.countDistinct("page_index").alias("n_pages")).where(F.col("n_pages") >= RUNNING_HEAD_PAGES)


def strip_furniture(lines: DataFrame) -> DataFrame:
    """Without running heads, page numbers and stamps in the margins. Lines of the body all stay, and aren't joined with the heads."""
    heads = keep(running_heads(lines).select("book_key", "head_key", F.lit(True).alias("__head")), "heads")
    few = heads.count() <= MAX_BROADCAST_ROWS
    margin = F.coalesce("in_band", F.lit(True))
    gone = F.col("in_band") & text.is_furniture(F.col("text"), F.coalesce(F.col("__head"), F.lit(False)))

    def stripped(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("head_key", F.when(margin, text.head_key(F.col("text")))).join(F.broadcast(heads) if few else heads, ["book_key", "head_key"], "left")
        return keyed.where(~gone).drop("head_key", "__head")

    return stripped(lines) if few else stripped(lines.where(margin)).unionByName(lines.where(~margin))


def body_sizes(lines: DataFrame) -> DataFrame:
    """(book_key, body_size): the exact median of the sizes above 0, 12 without any."""
    return lines.groupBy("book_key").agg(F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(DEFAULT_BODY_SIZE)).alias("body_size"))


def page_gaps(lines: DataFrame) -> DataFrame:
    """(book_key, page_index, page_gap): the median of the downward steps from line to line, 0 without any."""
    step = F.col("y0") - F.lag("y0").over(Window.partitionBy("book_key", "page_index").orderBy("line_no"))
    steps = lines.withColumn("step", step)
    return steps.groupBy("book_key", "page_index").agg(F.coalesce(F.median(F.when(F.col("step") > 0, F.col("step"))), F.lit(0.0)).alias("page_gap"))


def left_margins(lines: DataFrame) -> DataFrame:
    """(book_key, parity, margin): the most frequent rounded left edge of even and odd pages, of several the one that came first."""
    edges = lines.select("book_key", F.pmod("page_index", F.lit(2)).alias("parity"), F.bround("x0").alias("margin"), F.struct("page_index", "line_no").alias("at"))
    counts = edges.groupBy("book_key", "parity", "margin").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    best = lambda keys: counts.groupBy(*keys, "margin").agg(F.sum("n").alias("n"), F.min("first").alias("first")).groupBy(*keys).agg(F.min_by("margin", F.struct(-F.col("n"), F.col("first"))).alias("margin"))
    books = best(["book_key"]).withColumnRenamed("margin", "whole").withColumn("parity", F.explode(F.array(F.lit(0), F.lit(1))))
    return books.join(best(["book_key", "parity"]), ["book_key", "parity"], "left").select("book_key", "parity", F.coalesce("margin", "whole").alias("margin"))


def marked_lines(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """Body lines with what the reflow needs: is_heading, breaks (an indent or a wide gap). outline: (book_key, title)."""
    titles = outline.select("book_key", F.lower(text.collapse(F.col("title"))).alias("__title")).where(F.length("__title") > 0).distinct().withColumn("__declared", F.lit(True))
    places = keep(lines.select("book_key", "page_index", "line_no", "x0", "size"), "places")
    of_page = Window.partitionBy("book_key", "page_index")
    step = F.col("y0") - F.lag("y0").over(of_page.orderBy("line_no"))
    rows = lines.withColumn("__step", step).withColumn("__page_gap", F.coalesce(F.median(F.when(F.col("__step") > 0, F.col("__step"))).over(of_page), F.lit(0.0)))
    titles = keep(titles, "titles")
    if n_titles := titles.count():
        rows = rows.withColumn("__title", F.lower(text.collapse(F.col("text")))).join(F.broadcast(titles) if n_titles <= MAX_BROADCAST_ROWS else titles, ["book_key", "__title"], "left")
    else:
        rows = rows.withColumn("__declared", F.lit(False))
    rows = rows.withColumn("parity", F.pmod("page_index", F.lit(2))).join(_side(left_margins(places).join(body_sizes(places), "book_key"), "margins"), ["book_key", "parity"])
    wide = F.coalesce((F.col("__page_gap") > 0) & (F.col("__step") > GAP * F.col("__page_gap")), F.lit(False))
    indented = F.col("x0") > F.col("margin") + INDENT * F.col("body_size")
    heading = ~_longer(F.col("text"), text.HEADING_WORDS_MAX) & text.is_heading_line(F.col("text"), F.col("size"), F.col("body_size"), F.coalesce(F.col("__declared"), F.lit(False)))
    return rows.withColumns({"is_heading": heading, "breaks": indented | wide}).select("book_key", "page_index", "line_no", "text", "y0", "size", "body_size", "is_heading", "breaks")


def _longer(line: Column, words: int) -> Column:
    """More than so many words, told by its beginning: long texts needn't go through tests that only short ones pass."""
    return line.rlike(rf"^[{text.WS}]*+(?:[^{text.WS}]++[{text.WS}]++){{{words}}}[^{text.WS}]")


def _side(df: DataFrame, name: str) -> DataFrame:
    """Kept, and broadcast to what it is joined with up to MAX_BROADCAST_ROWS, counted."""
    rows = keep(df, name)
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


#: Blocks as the fold of a range gives them. edge: the first or last block of its range, a paragraph of which may go on from the one before (follows)
#: or into the one after (goes_on); only its text isn't cleaned yet, and it says what its first line and its last line are like.
_FOLDED = (
    "book_key string, page_index int, text string, y0 double, size double, heading boolean, "
    "edge boolean, follows boolean, goes_on boolean, breaks boolean, lower boolean, incomplete boolean, comma boolean"
)
_FOLDED_NAMES = [c.split()[0] for c in _FOLDED.split(", ")]
#: Blocks leave the fold when they have so many characters together.
FOLDED_CHARS = 1 << 20


def _runs_on(incomplete: bool, comma: bool, breaks: bool, lower: bool) -> bool:
    """Whether a line that is no heading goes on with the paragraph before it."""
    return not breaks or (incomplete and (lower or comma))


def _with_comma(line: str) -> bool:
    return line.rstrip().endswith(",")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines (book_key, page_index, text, y0, size, body_size, is_heading, breaks) as blocks; only the open paragraph is held."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), *[pa.bool_()] * 8]
    rows: list[tuple] = []
    chars = 0
    key, open_lines, begun, first = None, [], (), None
    untold = True  # whether a block of an earlier range can go on here: nothing came yet

    def close(last: bool = False) -> None:
        nonlocal chars
        if open_lines:
            whole, follows = " ".join(open_lines), first is not None
            chars += len(whole)
            ends = (is_incomplete(open_lines[-1]), _with_comma(open_lines[-1])) if follows or last else (None, None)
            rows.append((key, begun[0], whole if follows or last else clean_text(whole), *begun[1:], False, follows or last, follows, last, *(first or (None, None)), *ends))
            open_lines.clear()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _FOLDED_NAMES)

    for lines in batches:
        for book, page, own, y0, size, body_size, is_heading, breaks in zip(*(c.to_pylist() for c in lines.columns), strict=True):
            if book != key:
                close()
                key = book
            if is_heading:
                close()
                rows.append((key, page, clean_text(own), y0, size, True, untold, False, False, *[None] * 4))  # at an edge nothing goes on over it
                chars += len(own)
            else:
                if open_lines and not _runs_on(breaks and is_incomplete(open_lines[-1]), breaks and _with_comma(open_lines[-1]), breaks, breaks and opens_lowercase(own)):
                    close()
                if not open_lines:
                    begun, first = (page, y0, body_size), (bool(breaks), opens_lowercase(own)) if untold else None
                    open_lines.append(own)
                elif (whole := joined(open_lines[-1], own)) is not None:
                    open_lines[-1] = whole
                else:
                    open_lines.append(own)
            untold = False
            if chars >= FOLDED_CHARS:
                yield batch()
                rows.clear()
                chars = 0
    close(last=True)
    if rows:
        yield batch()


def _stitched(book: pd.DataFrame) -> pd.DataFrame:
    """The blocks at the edges of a book's ranges, in order, with those that go on from range to range as one."""
    out: list[dict] = []
    for row in book.sort_values("at").to_dict("records"):
        before = out[-1] if out else None
        if before and before["goes_on"] and row["follows"] and _runs_on(before["incomplete"], before["comma"], row["breaks"], row["lower"]):
            whole = joined(before["text"], row["text"])
            before["text"] = f"{before['text']} {row['text']}" if whole is None else whole
            before |= {c: row[c] for c in ("goes_on", "incomplete", "comma")}
        else:
            out.append(row)
    return pd.DataFrame([row | {"text": clean_text(row["text"])} for row in out], columns=book.columns)


def reflow(marked: DataFrame) -> DataFrame:
    """Lines as blocks: book_key, block_no, kind, text, page_index, y0, size.

    Lines are joined to paragraphs, over page ends too; a heading line is a block of its own. A break is overlooked where the running
    text is unfinished and the line goes on in lower case or after a comma. That looks at the joined text, but only at its last line, so
    ranges of a book's lines are folded by themselves, and the few blocks at their edges are joined after that. Blocks are numbered by
    their place in their range and the number of blocks before the range.
    """
    dealt = marked.repartitionByRange("book_key", "page_index", "line_no").sortWithinPartitions("book_key", "page_index", "line_no")
    folded = dealt.select("book_key", "page_index", "text", "y0", "size", "body_size", "is_heading", "breaks").mapInArrow(_folded, _FOLDED)
    t = F.col("text")
    shown = F.when(F.col("heading"), ~text.is_contentless(t)).otherwise(~text.is_droppable(t))
    # ranges are in order, and so are the blocks of each: `at` is their order, without gaps among those of a range that aren't at its edges
    rows = keep(folded.where(F.col("edge") | shown).withColumn("at", F.monotonically_increasing_id()), "blocks", codec="zstd")
    columns = ["book_key", "text", "page_index", "y0", "size", "heading", "at"]
    whole = rows.where("not edge").select(*columns, F.shiftright("at", 33).alias("part"))
    stitched = keep(rows.where("edge").groupBy("book_key").applyInPandas(_stitched, rows.schema).where(shown).select(*columns, (-1 - F.col("at")).alias("part")), "stitched")
    blocks = whole.unionByName(stitched)
    sums = blocks.groupBy("book_key", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("book_key").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = _side(sums.select(F.col("book_key").alias("__book"), F.col("part").alias("__part"), (before - F.col("first")).alias("__start")), "starts")
    kind = F.when(F.col("heading"), "heading").when(~_longer(t, text.CREDIT_WORDS_MAX) & text.is_caption(t), "caption")
    kind = kind.when((~_longer(t, text.SCENE_WORDS_MAX) & text.is_scene_setter(t)) | text.is_gibberish(t), "other").otherwise("paragraph")
    numbered = blocks.join(starts, F.col("book_key").eqNullSafe(F.col("__book")) & (F.col("part") == F.col("__part")))
    return numbered.select("book_key", "text", "page_index", "y0", "size", kind.alias("kind"), (F.col("__start") + F.col("at")).alias("block_no"))


def content_starts(toc: DataFrame) -> DataFrame:
    """(book_key, start_no from 1, page_index, title) of an outline (book_key, ord, title, page from 1), without front and back matter,
    the first entry of each page."""
    body = toc.where(~text.names_front_matter(F.col("title")) & ~text.names_back_matter(F.col("title")))
    firsts = body.groupBy("book_key", (F.col("page") - 1).alias("page_index")).agg(F.min_by("title", "ord").alias("title"))
    return firsts.withColumn("start_no", F.row_number().over(Window.partitionBy("book_key").orderBy("page_index")))


def back_start(toc: DataFrame, starts: DataFrame) -> DataFrame:
    """(book_key, back_page): the first back-matter entry after the last start of content."""
    last = starts.groupBy("book_key").agg(F.max("page_index").alias("last"))
    back = toc.where(text.names_back_matter(F.col("title"))).join(last, "book_key", "left")
    return back.where(F.coalesce(F.col("page") - 1 > F.col("last"), F.lit(True))).groupBy("book_key").agg((F.min("page") - 1).alias("back_page"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its keys whose `at` isn't beyond its own; null without one.

    One union and one window instead of an inequality join; left and right rows stay in proportion.
    """
    columns = [c for c in left.columns if c not in values]
    rows = left.select(*columns, F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__right"))
    fill = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in left.select(*columns).schema if f.name not in [*keys, at]}
    marks = right.select(*[F.col(c) if c in [*keys, at] else fill[c] for c in columns], F.lit(0).alias("__side"), F.struct(*values).alias("__right"))
    window = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(marks).withColumn("__last", F.last("__right", ignorenulls=True).over(window)).where("__side = 1")
    return found.select(*columns, *[F.col(f"__last.{v}").alias(v) for v in values])


def chapters_by_outline(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """Blocks with chapter_index and chapter_title of the outline: 0 before the first start (without gibberish), one trailing chapter
    from the back matter on."""
    starts = content_starts(toc)
    located = as_of(blocks, starts.select("book_key", "page_index", "start_no", F.col("title").alias("start_title")), ["book_key"], "page_index", ["start_no", "start_title"])
    ends = starts.groupBy("book_key").agg(F.max("start_no").alias("n_starts"))
    located = located.join(back_start(toc, starts), "book_key", "left").join(ends, "book_key", "left")
    back = F.coalesce(F.col("page_index") >= F.col("back_page"), F.lit(False))
    index = F.when(back, F.coalesce("n_starts", F.lit(0)) + 1).otherwise(F.coalesce("start_no", F.lit(0)))
    title = F.when(back, BACK_CHAPTER).otherwise(F.coalesce("start_title", F.lit(FRONT_CHAPTER)))
    placed = located.withColumns({"chapter_index": index.cast("int"), "chapter_title": title})
    kept = placed.where((F.col("chapter_index") > 0) | ~text.is_gibberish(F.col("text")))
    return kept.drop("start_no", "start_title", "back_page", "n_starts")


def body_bracket(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_key, front_end, back_start): after the last contents page in the first quarter, before the first margin that names back
    matter in the second half. pages: (book_key, n_pages)."""
    key = text.head_key(F.col("text"))
    rows = lines.join(pages, "book_key")
    contents = F.when((key == "contents") & (F.col("page_index") <= F.col("n_pages") * FRONT_SHARE), F.col("page_index") + 1)
    back = F.when(F.col("in_band") & key.isin(*text.BACK_KEYS) & (F.col("page_index") >= F.col("n_pages") * BACK_SHARE), F.col("page_index"))
    return rows.groupBy("book_key").agg(F.coalesce(F.max(contents), F.lit(0)).alias("front_end"), F.coalesce(F.min(back), F.first("n_pages")).alias("back_start"))


def chapters_by_headings(blocks: DataFrame, bracket: DataFrame) -> DataFrame:
    """Blocks with chapter_index and chapter_title without an outline: strong headings open chapters between front and back matter.

    A label and the title after it, without a paragraph between, are one chapter. States follow each other: a fold by book.
    """
    rows = blocks.join(bracket, "book_key").withColumns({
        "strong": (F.col("kind") == "heading") & text.is_strong_chapter(F.col("text"), F.col("size"), F.col("body_size")),
        "label": text.starts_with_word(F.col("text"), text.CHAPTER_LABELS),
        "debris": text.is_gibberish(F.col("text")),
    })
    names = [f.name for f in blocks.schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema) + ", chapter_index int, chapter_title string"

    def fold(book: pd.DataFrame) -> pd.DataFrame:
        index, title, phase, fresh, label = 0, FRONT_CHAPTER, "front", False, False
        out = []
        for b in book.sort_values("block_no").itertuples():
            if phase != "back" and b.page_index >= b.back_start:
                phase, index, title, fresh = "back", index + 1, BACK_CHAPTER, False
            if b.strong and (phase == "body" or (phase == "front" and b.page_index >= b.front_end)):
                if phase == "body" and fresh:
                    if label and not b.label:
                        title, label = b.text, False
                else:
                    index, title, fresh, label = index + 1, b.text, True, b.label
                phase = "body"
            if phase == "front" and b.debris:
                continue
            out.append((*[getattr(b, n) for n in names], index, title))
            fresh = fresh and b.kind != "paragraph"
        return pd.DataFrame(out, columns=[*names, "chapter_index", "chapter_title"])

    return rows.groupBy("book_key").applyInPandas(fold, schema)


def segments_of_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with chapters as segments: positions in order, heading levels by size, content ids."""
    rows = row_index(blocks, ["book_key"], ["block_no"], "position")
    level = F.when(F.col("kind") == "heading", text.heading_level(F.col("size"), F.col("body_size")))
    out = rows.withColumn("heading_level", level).withColumn("id", identity.segment_id(F.col("text"), F.col("chapter_index"), F.col("position")))
    return out.select("book_key", "chapter_index", "chapter_title", "position", F.col("kind").alias("type"), "heading_level", "text", "id", "block_no", "page_index", "y0")


def kept_images(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Images (book_key, image_no, page_index, y0, y1, width, height, area_ratio, digest) that are figures.

    None of a book whose pages are scans; no ornaments, no full-page scans, nothing that is on three pages or more; of the rest the
    first placement of each.
    """
    scans = images.where(F.col("area_ratio") >= SCAN_AREA).groupBy("book_key").agg(F.countDistinct("page_index").alias("n")).join(pages, "book_key")
    scanned = scans.where(F.col("n") >= SCAN_SHARE * F.col("n_pages")).select("book_key")
    sized = images.where((F.least("width", "height") >= LEAST_IMAGE_PIXELS) & (F.col("area_ratio") < FULL_PAGE_AREA)).join(scanned, "book_key", "left_anti")
    often = sized.groupBy("book_key", "digest").agg(F.countDistinct("page_index").alias("n")).where(F.col("n") >= RECURRING_PAGES)
    rest = sized.join(often, ["book_key", "digest"], "left_anti")
    return rest.withColumn("nth", F.row_number().over(Window.partitionBy("book_key", "digest").orderBy("image_no"))).where("nth = 1").drop("nth")


def anchored_images(images: DataFrame, segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Images with anchor_id: the segment they follow, null before the first.

    That is the last one that begins at or above the image; where exactly one caption is within four lines of the image, the one
    before that caption.
    """
    places = segments.select("book_key", F.struct("page_index", "y0").alias("at"), F.col("position").alias("above"))
    located = as_of(images.withColumn("at", F.struct("page_index", "y0")), places.groupBy("book_key", "at").agg(F.max("above").alias("above")), ["book_key"], "at", ["above"]).drop("at")
    captions = segments.where("type = 'caption'").select("book_key", "page_index", F.col("y0").alias("caption_y"), F.col("position").alias("caption"))
    near = images.join(sizes, "book_key").join(captions, ["book_key", "page_index"])
    slack = CAPTION_LINES * F.col("body_size")
    near = near.where(F.col("caption_y").between(F.col("y0") - slack, F.col("y1") + slack)).groupBy("book_key", "image_no").agg(F.count("*").alias("n"), F.min("caption").alias("caption")).where("n = 1")
    joined_ = located.join(near.select("book_key", "image_no", "caption"), ["book_key", "image_no"], "left")
    position = F.when(F.col("caption").isNotNull(), F.col("caption") - 1).otherwise(F.col("above"))
    ids = segments.select("book_key", F.col("position").alias("anchor"), F.col("id").alias("anchor_id"))
    return joined_.withColumn("anchor", position.cast("long")).join(ids, ["book_key", "anchor"], "left").drop("above", "caption", "anchor")

import bisect
import random

import pandas as pd
import pyarrow as pa

from folioflux.functions.patterns import clean_text
from folioflux.operators import layout


def lines(spark, rows):
    df = spark.createDataFrame([("b", *r, 800.0) for r in rows], "book_key string, page_index int, line_no int, text string, x0 double, y0 double, size double, page_height double")
    return layout.ordered_lines(df)


NO_OUTLINE = "book_key string, title string"


def page(number, texts, *, head=None, indent=()):
    out = [] if head is None else [(number, 0, f"{number} {head}", 50.0, 20.0, 9.0)]
    return out + [(number, i + 1, t, 65.0 if i in indent else 50.0, 100.0 + 12 * i, 18.0 if t.isupper() else 10.0) for i, t in enumerate(texts)]


def test_reflow_joins_lines_and_drops_furniture(spark):
    rows = [
        *page(0, ["CHAPTER ONE", "The first para-", "graph goes on and", "on and", "on and", "on and", "ends here.", "Second one begins", "and"], head="THE BOOK", indent=(1, 7)),
        *page(1, ["goes on over the page.", "Anti-", "American words stay."], head="THE BOOK", indent=(1,)),
        *page(2, ["November 2020", "(A Library)", "Xqz wxy"], head="THE BOOK", indent=(0, 1, 2)),
    ]
    body = layout.strip_furniture(lines(spark, rows))
    assert body.count() == len(rows) - 3
    blocks = layout.reflow(layout.marked_lines(body, spark.createDataFrame([], NO_OUTLINE))).orderBy("block_no").collect()
    assert [(b["kind"], b["text"]) for b in blocks] == [
        ("heading", "CHAPTER ONE"), ("paragraph", "The first paragraph goes on and on and on and on and ends here."), ("paragraph", "Second one begins and goes on over the page."),
        ("paragraph", "Anti-American words stay."), ("other", "November 2020"), ("caption", "(A Library)"), ("other", "Xqz wxy"),
    ]
    assert [b["block_no"] for b in blocks] == list(range(7)) and blocks[2]["page_index"] == 0


def test_chapters_with_and_without_outline(spark):
    rows = [*page(0, ["wa", "Some Publisher Incorporated."], indent=(0, 1)), *page(1, ["CHAPTER ONE", "THE OPENING WORDS", "Real body text here."]), *page(2, ["Another body text.", "CHAPTER TWO", "More text", "goes on", "and on", "to its end."], indent=(0,)), *page(3, ["NOTES", "Some note text."])]
    marked = layout.marked_lines(lines(spark, rows), spark.createDataFrame([], NO_OUTLINE))
    blocks = layout.reflow(marked).join(layout.body_sizes(lines(spark, rows)), "book_key").persist()
    bracket = spark.createDataFrame([("b", 1, 3)], "book_key string, front_end int, back_start int")
    found = layout.chapters_by_headings(blocks, bracket).orderBy("block_no").collect()
    assert [(b["text"], b["chapter_index"], b["chapter_title"]) for b in found][:2] == [("Some Publisher Incorporated.", 0, "Front Matter"), ("CHAPTER ONE", 1, "CHAPTER ONE")]
    assert {(b["chapter_index"], b["chapter_title"]) for b in found if b["page_index"] == 2} >= {(2, "CHAPTER TWO")} and {b["chapter_title"] for b in found if b["page_index"] == 3} == {"Notes"}
    assert [b["chapter_title"] for b in found if b["text"] == "Real body text here."] == ["THE OPENING WORDS"]
    toc = spark.createDataFrame([("b", 0, "Contents", 1), ("b", 1, "One", 2), ("b", 2, "Same page", 2), ("b", 3, "Two", 3), ("b", 4, "Notes", 4)], "book_key string, ord int, title string, page int")
    placed = layout.chapters_by_outline(blocks, toc).orderBy("block_no").collect()
    assert [(b["page_index"], b["chapter_index"], b["chapter_title"]) for b in placed][0] == (0, 0, "Front Matter")
    assert {(b["page_index"], b["chapter_index"], b["chapter_title"]) for b in placed} == {(0, 0, "Front Matter"), (1, 1, "One"), (2, 2, "Two"), (3, 3, "Notes")}
    segments = layout.segments_of_blocks(layout.chapters_by_outline(blocks, toc)).orderBy("position").collect()
    assert [s["position"] for s in segments] == list(range(len(segments))) and all((s["heading_level"] is not None) == (s["type"] == "heading") for s in segments)


def test_bracket(spark):
    rows = [*page(0, ["Contents"]), *page(1, ["x"]), *page(2, ["x"]), *page(3, ["Contents"]), *[(7, 0, "Notes 12", 50.0, 10.0, 10.0)]]
    got = layout.body_bracket(lines(spark, rows), spark.createDataFrame([("b", 10)], "book_key string, n_pages int")).first()
    assert (got["front_end"], got["back_start"]) == (1, 7)


def test_as_of_is_bisect(spark):
    rng = random.Random(2)
    left = [(rng.choice("xy"), rng.randrange(50), i) for i in range(200)]
    right = [(k, at, f"{k}{at}") for k in "xy" for at in rng.sample(range(50), 12)]
    got = layout.as_of(spark.createDataFrame(left, "k string, at int, i int"), spark.createDataFrame(right, "k string, at int, v string"), ["k"], "at", ["v"]).collect()
    for r in got:
        own = sorted(at for k, at, _ in right if k == r["k"])
        n = bisect.bisect_right(own, r["at"])
        assert r["v"] == (f"{r['k']}{own[n - 1]}" if n else None)
    assert len(got) == 200


def test_images(spark):
    schema = "book_key string, image_no int, page_index int, y0 double, y1 double, width int, height int, area_ratio double, digest string"
    rows = [("b", 1, 0, 5.0, 9.0, 100, 100, 0.2, "logo"), ("b", 2, 1, 5.0, 9.0, 100, 100, 0.2, "logo"), ("b", 3, 2, 5.0, 9.0, 100, 100, 0.2, "logo"), ("b", 4, 1, 50.0, 90.0, 100, 100, 0.3, "fig"), ("b", 5, 2, 50.0, 90.0, 100, 100, 0.3, "fig"), ("b", 6, 1, 5.0, 9.0, 10, 100, 0.1, "rule"), ("b", 7, 1, 0.0, 9.0, 100, 100, 0.95, "scan"), ("s", 1, 0, 0.0, 9.0, 100, 100, 0.6, "p0")]
    pages = spark.createDataFrame([("b", 10), ("s", 2)], "book_key string, n_pages int")
    kept = layout.kept_images(spark.createDataFrame(rows, schema), pages)
    assert [(r["book_key"], r["image_no"]) for r in kept.collect()] == [("b", 4)]
    segments = spark.createDataFrame([("b", 0, "paragraph", 0, 10.0, "s0"), ("b", 1, "paragraph", 1, 10.0, "s1"), ("b", 2, "paragraph", 1, 40.0, "s2"), ("b", 3, "caption", 1, 100.0, "s3")], "book_key string, position long, type string, page_index int, y0 double, id string")
    sizes = spark.createDataFrame([("b", 10.0)], "book_key string, body_size double")
    images = spark.createDataFrame([("b", 1, 0, 5.0, 9.0), ("b", 2, 1, 50.0, 90.0), ("b", 3, 1, 12.0, 20.0)], "book_key string, image_no int, page_index int, y0 double, y1 double")
    got = {r["image_no"]: r["anchor_id"] for r in layout.anchored_images(images, segments, sizes).collect()}
    assert got == {1: None, 2: "s2", 3: "s1"}


def test_ranges_of_lines_fold_to_the_same_blocks_wherever_they_are_cut():
    rng = random.Random(5)
    words = ["on", "end.", "Begin", "so,", "a-", "-", "", '"', 'end."', "so-", "Up-"]
    names = ["book_key", "page_index", "text", "y0", "size", "body_size", "is_heading", "breaks"]
    rows = [("b" if i < 90 else "c", i // 4, " ".join(rng.choices(words, k=rng.randint(1, 2))), float(i), 9.0, 8.0, rng.random() < 0.1, rng.random() < 0.6) for i in range(160)]
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some, strict=True)], names)
    columns = ["book_key", "page_index", "text", "y0", "size", "heading"]

    def blocks(cuts):
        ranges = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True) if a < b]
        found = [r | {"at": (i << 33) + n} for i, some in enumerate(ranges) for n, r in enumerate(x for out in layout._folded([batch(some[:3]), batch(some[3:])] if len(some) > 3 else [batch(some)]) for x in out.to_pylist())]
        edges = pd.DataFrame([r for r in found if r["edge"]])
        joined = [r for _, book in edges.groupby("book_key") for r in layout._stitched(book).to_dict("records")] if len(edges) else []
        return [tuple(r[c] for c in columns) for r in sorted([*(r for r in found if not r["edge"]), *joined], key=lambda r: r["at"])]

    whole = blocks([])
    assert len(whole) > 40 and all(t == clean_text(t) for _, _, t, *_ in whole)
    assert all(blocks(sorted(rng.sample(range(1, len(rows)), k))) == whole for k in (1, 2, 5, 20, 60, 120) for _ in range(10)) and blocks(range(1, len(rows))) == whole

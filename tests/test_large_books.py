"""What large books and samples need: nothing whole in memory, nothing computed once a line, draws that aren't shuffled."""

import io

from pyspark.sql import functions as F

from folioflux.functions import text
from folioflux.operators import sampling
from folioflux.sources import books, epub


def test_an_archive_is_written_and_read_by_chapters(monkeypatch):
    out = io.BytesIO()
    writer = epub.Writer({"book_key": "k", "title": "T", "authors": [], "language": "sl"}, {0: 3, 1: 1}, out)
    for i, chapter in enumerate((0, 0, 1, 0)):  # chapters interleave
        writer.row({"id": str(i), "type": "paragraph", "text": f"t{i}", "chapter_index": chapter, "chapter_title": f"c{chapter}", "heading_level": None})
        assert sum(len(rows) for _, rows in writer.begun.values()) == (1, 2, 2, 0)[i]
    writer.close()
    found = list(epub.rows_of(out, "k", 1))
    assert [(r[3], r[4], r[5]) for r in found] == [("t0", 0, "c0"), ("t1", 0, "c0"), ("t3", 0, "c0"), ("t2", 1, "c1")]
    monkeypatch.setattr(epub, "BATCH_ROWS", 3)
    assert [len(b) for b in epub.batched(iter(found))] == [3, 1]


def test_titles_are_prepared_once_for_all_parts(spark):
    assert str(text.title_contains(F.col("t"), ("a", "b.c", "d"))).count("lower") == 1
    df = spark.createDataFrame([("xB.C",), ("bxc",), (None,)], "t string")
    assert [r[0] for r in df.select(text.title_contains(F.col("t"), ("q", "b.c"))).collect()] == [True, False, False]


def test_draws_meet_broadcast_items(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = spark.createDataFrame([("s", i, float(i)) for i in range(5)], "source string, index long, value double")
        means = sampling.resampled_means(items, ["source"], ["value"], seed=1, resamples=3)
        assert "SortMergeJoin" not in means._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_json_books_are_written_and_read_in_pieces(spark):
    about = spark.createDataFrame([(k, f'"{k}", T', ["A"], "sl") for k in "abc"], "book_key string, title string, authors array<string>, language string")
    texts = [("a", i, f',[{{"x": {i}}}]\n' if i % 3 else None) for i in range(200)] + [("b", 7, "one"), ("x", 0, "of no book")]
    rows = spark.createDataFrame([(f"{k}{i}", "paragraph", t, i // 9, "C", i, None, k) for k, i, t in texts], "id string, type string, text string, chapter_index int, chapter_title string, position long, heading_level int, book_key string").repartition(5)
    images = spark.createDataFrame([("a", f"i{i}", "image/png", bytes([i]), None, i, None, "x") for i in range(30)] + [("c", "i", "image/png", b"c", None, 0, None, "x")], "book_key string, image_id string, media_type string, data binary, source_href string, chapter_index int, anchor_id string, alt string")
    for pictures in (images, None):
        pieces = books.json_pieces(about, rows, pictures, chars=1000).persist()
        found = pieces.orderBy("book_key", "piece").collect()
        assert len(found) > 20 and max(len(r["json"]) for r in found) < 1400
        whole = books.to_json(about, rows, pictures)
        assert {k: "".join(r["json"] for r in found if r["book_key"] == k) for k in "abc"} == {r["book_key"]: r["json"] for r in whole.collect()}
        for some, all_at_once in zip(books.from_json_pieces(pieces), books.from_json(whole), strict=True):
            assert some.columns == all_at_once.columns and sorted(map(str, some.collect())) == sorted(map(str, all_at_once.collect()))

import inspect
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflux.operators import sampling, store
from folioflux.plans import connectors, evaluate, execute, styles
from folioflux.sources import epub, html


def archive(documents, *, ncx=None, nav=None, media=(), title="The Book"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        items = [f'<item id="d{i}" href="d{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(documents))] + [f'<item id="m{i}" href="{n}" media-type="image/png"/>' for i, (n, _) in enumerate(media)]
        if ncx:
            items.append('<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/>')
            z.writestr("o/toc.ncx", "<ncx>" + "".join(f'<navPoint><navLabel><text>{t}</text></navLabel><content src="{s}"/></navPoint>' for t, s in ncx) + "</ncx>")
        if nav:
            items.append('<item id="v" href="nav.xhtml" properties="nav"/>')
            z.writestr("o/nav.xhtml", f'<html xmlns:epub="e"><body><nav epub:type="toc">{nav}</nav></body></html>')
        spine = "".join(f'<itemref idref="d{i}"/>' for i in range(len(documents)))
        z.writestr("o/p.opf", f"<package><metadata><title>{title}</title><creator>A. Author</creator><language>en</language></metadata><manifest>{''.join(items)}</manifest><spine>{spine}<itemref idref='gone'/></spine></package>")
        for i, d in enumerate(documents):
            z.writestr(f"o/d{i}.xhtml", d if d.startswith("<?") or d.startswith("<html") else f"<html><head><title>The Book</title></head><body>{d}</body></html>")
        for n, data in media:
            z.writestr(f"o/{n}", data)
    return out.getvalue()


def test_reading_blocks_titles_and_images():
    docs = ['<img src="cover.png"/>', "<h1>One</h1><p>Text <em>with</em> <span>inline</span>&nbsp;<br>marks & more</p><ul><li>item</li></ul>", "<p><b>Bold Heading</b></p><p>Some <b>bold</b> inside<img src='fig.png' alt='f'/></p>", "<nav><p>skipped</p></nav><blockquote>Quote</blockquote><p class='caption'>Cap</p>"]
    raw = archive(docs, ncx=[("Chapter One", "d1.xhtml#x"), ("Other", "d1.xhtml")], media=[("cover.png", b"c"), ("fig.png", b"f")])
    book, segments, images = epub.read_book(raw, "k")
    assert book[1:4] == ("The Book", ["A. Author"], "en")
    assert [(s[2], s[3], s[4], s[5], s[7]) for s in segments] == [
        ("heading", "One", 0, "Chapter One", 1), ("paragraph", "Text <em>with</em> inline marks & more", 0, "Chapter One", None), ("list_item", "item", 0, "Chapter One", None), ("heading", "<b>Bold Heading</b>", 1, "Chapter One", 2),
        ("paragraph", "Some <b>bold</b> inside", 1, "Chapter One", None), ("blockquote", "Quote", 2, "Chapter One", None), ("caption", "Cap", 2, "Chapter One", None),
    ]
    assert [s[6] for s in segments] == list(range(7))
    assert [(i[1], i[4], i[5], i[6], i[7]) for i in images] == [("img0001", "o/cover.png", 0, None, None), ("img0002", "o/fig.png", 1, segments[4][1], "f")]


def test_titles_without_an_outline_and_with_an_empty_one():
    docs = ["<h2>First</h2><p>a</p>", "<html><head><title>Own</title></head><body><p>b</p></body></html>", "<p>c</p>"]
    assert [s[5] for s in epub.read_book(archive(docs, ncx=[]), "k")[1]] == ["First", "First", "Own", "The Book"]
    nav = '<ol><li><a href="d2.xhtml">Third</a></li></ol>'
    assert [s[5] for s in epub.read_book(archive(docs, nav=nav), "k")[1]] == ["First", "First", "First", "Third"]


def test_recurring_images_are_carried_once():
    _, _, images = epub.read_book(archive(["<p>x</p><img src='a.png'/><img src='b.png'/>"] * 3 + ["<p>y</p><img src='b.png'/>"], media=[("a.png", b"1"), ("b.png", b"2")]), "k")
    assert sorted(i[4] for i in images) == ["o/a.png", "o/b.png"]


def test_nothing_is_lost_in_silence(spark, tmp_path):
    with pytest.raises(epub.EpubError, match="d0.xhtml"):
        epub.read_book(archive(["<p>open <i>never closed</p>"]), "k")
    (tmp_path / "good.epub").write_bytes(archive(["<p>x</p>"]))
    (tmp_path / "bad.epub").write_bytes(b"not a zip")
    (tmp_path / "other.mobi").write_bytes(b"x")
    files = epub.read(spark, str(tmp_path))
    assert {(r["book_key"], r["status"]) for r in epub.books(files).collect()} == {("good", "ok"), ("bad", "failed"), ("other", "failed")}
    assert epub.segments(files.where("book_key = 'good'")).count() == 1
    for name in ("bad", "other"):
        with pytest.raises(Exception, match=name):
            epub.segments(files.where(F.col("book_key") == name)).collect()


def test_books_are_the_same_bytes_and_read_back(spark):
    raw = archive(["<h1>One</h1><p>A <em>b</em> &amp; c &lt; d</p><ul><li>i</li><li>j</li></ul>", "<blockquote>q</blockquote><p class='other'>o</p><img src='f.png'/>"], ncx=[("First", "d0.xhtml"), ("Second", "d1.xhtml")], media=[("f.png", b"png")])
    files = spark.createDataFrame([("k", raw, ".epub")], "book_key string, content binary, suffix string")
    books, segments, images = epub.books(files), epub.segments(files).persist(), epub.images(files)
    one, two = [epub.build_books(books, s, images).first()["epub"] for s in (segments, segments.repartition(3))]
    assert one == two
    _, back, pictures = epub.read_book(bytes(one), "k")
    want = [tuple(r) for r in segments.orderBy("position").collect()]
    assert [s[1:] for s in back] == [w[1:] for w in want] and len(pictures) == 1 and pictures[0][6] == want[-1][1]
    double = epub.build_books(books, segments, images, segments.select("book_key", "id", "text")).first()["epub"]
    assert b"source" in zipfile.ZipFile(io.BytesIO(bytes(double))).read("chapter_0001.xhtml")


@pytest.mark.parametrize(("text", "want"), [("a & <b>x</b>", "a &amp; <b>x</b>"), ("<EM>x</EM>", "<em>x</em>"), ("<b>x", "&lt;b>x"), ("<i><b>x</i></b>", "&lt;i>&lt;b>x&lt;/i>&lt;/b>"), ("1 < 2", "1 &lt; 2"), ("<u>x</u>", "&lt;u>x&lt;/u>")])
def test_inline_markup(text, want):
    assert epub.render_inline(text) == want


def test_repairs(spark):
    raw = b'<?xml version="1.0"?><p>a &nbsp; b & c <br> <img alt="3 > 2" src="x"> &#65; <hr/></p>'
    root, status, done = html.parse(raw)
    assert status == "recovered" and done == ["entities", "ampersands", "void elements"] and root is not None
    assert html.parse(b"<p>x</p>")[1] == "strict" and html.parse(b"<p><b>x</p>")[1].startswith("failed")
    rows = spark.createDataFrame([(1, "<html><body><p>x</p></body></html>"), (2, "<p><b>x</p>"), (3, None)], "id long, h string")
    assert {r["id"]: (r["status"], r["n_blocks"]) for r in html.parse_status(rows, "id", "h").collect()} == {1: ("strict", 1), 2: ("failed", 0), 3: ("failed", 0)}
    page = "<p>one<p>two &amp; <script>var t='</p>'</script>three<li>x</li><nav><p>no</p></nav>"
    assert [(r["type"], r["text"]) for r in html.tolerant_blocks(spark.createDataFrame([(1, page)], "id long, h string"), "id", "h").orderBy("position").collect()][:2] == [("paragraph", "one"), ("paragraph", "two & three")]


# ---- execution


def small_book(spark, n=25):
    rows = [("b", i // 9, "C", i, "paragraph", None, f"Sentence number {i}." if i % 8 else " ", f"i{i}") for i in range(n)]
    return spark.createDataFrame(rows, "book_key string, chapter_index int, chapter_title string, position long, type string, heading_level int, text string, id string")


KEY = {"book_hash": "h", "model": "gpt-5-mini", "lang": "sl"}


def test_translation_resumes_without_calls_and_lanes_do_not_matter(spark, tmp_path):
    book = small_book(spark)
    seen = []
    texts = {}
    for lanes in (1, 4):
        cache = store.Store(spark, str(tmp_path / f"c{lanes}"))
        out = execute.translate(book, cache, connectors.EchoClient, **KEY, batch_size=4, lanes=lanes, on_progress=seen.append)
        texts[lanes] = {r["id"]: r["target_text"] for r in out.collect()}
        calls = cache.read("calls").count()
        assert calls > 0 and store.accounting(cache.read("calls"), ["kind"]).first()["cost_eur"] > 0
        again = execute.translate(book, cache, connectors.EchoClient, **KEY, batch_size=4, lanes=lanes)
        assert {r["id"]: r["target_text"] for r in again.collect()} == texts[lanes] and cache.read("calls").count() == calls
    assert texts[1] == texts[4] and texts[1]["i1"].endswith("Sentence number 1.") and texts[1]["i8"] == " " and seen


def test_refusals_go_to_the_fallback_or_raise(spark, tmp_path):
    book = small_book(spark, 10)
    refusing = lambda: connectors.EchoClient(refuse="number 3")
    with pytest.raises(Exception, match="refused"):
        execute.translate(book, store.Store(spark, str(tmp_path / "a")), refusing, **KEY)
    out = execute.translate(book, store.Store(spark, str(tmp_path / "b")), refusing, **KEY, make_fallback=connectors.EchoClient)
    assert out.where("target_text is null").count() == 0


def test_ladder_retries_and_falls_back_to_single_calls():
    class Bad:
        model = "gpt-5-mini"

        def __init__(self):
            self.calls = 0

        def complete(self, prompt, *, system=None):
            self.calls += 1
            if "[[2]]" in prompt and "REVISE" not in prompt:
                return connectors.Completion("garbage", 1, 1, 0.0, self.model)
            if "REVISE" in prompt:
                raise connectors.TruncatedCompletion("cut", connectors.Completion("", 1, 9, 0.1, self.model))
            return connectors.EchoClient().complete(prompt)

    lane = execute.Lane(client := Bad(), revise=True)
    assert [t.split("> ")[1] for t in lane.run(["a", "b"], "head")] == ["a", "b"] and client.calls == 2 + 2 + 2 and len(lane.billed) == 6
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError

        return "ok"

    slept = []
    assert connectors.retrying(flaky, is_retryable=lambda e: True, sleep=slept.append) == "ok" and 1 <= slept[0] < 2 <= slept[1] < 3
    with pytest.raises(ConnectionError):
        connectors.retrying(lambda: (_ for _ in ()).throw(ConnectionError()), is_retryable=lambda e: False)


def test_scoring_and_experiment_end_to_end(spark):
    source = small_book(spark, 60)
    target = source.withColumn("text", F.when(F.length(F.trim("text")) > 0, F.concat(F.lit("prevod "), "text")).otherwise(F.col("text")))
    judge = lambda: connectors.Judge(connectors.EchoClient())
    glossary = spark.createDataFrame([("number", "number")], "term string, rendering string")
    rows, totals = evaluate.score_books(source, target, judge, sample_size=12, glossary=glossary, costs=spark.createDataFrame([("b", 0.001)], "book_key string, cost_eur double"), repeats=2, resamples=50)
    got = {r["key"]: r for r in rows.collect()}
    assert set(got) == {f"T{i}" for i in range(1, 8)} and got["T5"]["fraction"] == 1.0 and got["T4"]["fraction"] == 1.0 and got["T1"]["fraction"] < 1
    assert got["T2"]["ci_low"] <= got["T2"]["fraction"] * 30 <= got["T2"]["ci_high"] and totals.first()["total"] == 40.0
    controls = source.select("book_key", "id", F.col("text").alias("control"))
    plan = evaluate.plan_experiment(source, controls, variant="v2", control_version="v1", runs=3).persist()
    assert plan.count() == 9
    delta = {r["key"]: r for r in evaluate.run_experiment(plan, target.select("book_key", "id", F.col("text").alias("target_text")), judge, resamples=50).collect()}
    assert set(delta) == {"T2", "T3"} and delta["T2"]["n_clusters"] == 3 and delta["T2"]["low_power"]
    with pytest.raises(evaluate.ExperimentError):
        evaluate.plan_experiment(source, controls, variant="v1", control_version="v1")
    with pytest.raises(evaluate.ExperimentError):
        evaluate.run_experiment(plan, target.limit(1).select("book_key", "id", F.col("text").alias("target_text")), judge)


def test_pdf_books_are_screened_and_totals_have_intervals(spark):
    class Marks(connectors.EchoClient):
        def complete(self, prompt, *, system=None):
            n = int(prompt.split("number ")[1].split(".")[0])
            return self._billed(prompt, f"SCORE: {int(n % 4 > 0)}" if prompt.startswith("EXTRACTION") else f"SCORE: {n % 5 + 1}")

    one = small_book(spark, 60).where("position % 8 <> 0")
    source = one.unionByName(one.withColumn("book_key", F.lit("p")))
    formats = spark.createDataFrame([("b", "epub"), ("p", "pdf")], "book_key string, source_format string")
    rows, totals = evaluate.score_books(source, source, lambda: connectors.Judge(Marks()), sample_size=12, resamples=200, formats=formats)
    got = {(r["book_key"], r["key"]): r for r in rows.collect()}
    body = [int(r["text"].split()[2][:-1]) for r in sampling.hash_sample(one, F.col("id"), evaluate.SCREENED, 43).collect()]
    want = sum(n % 4 > 0 for n in body) / 20
    assert len(body) == 20 and want < 1 and got["p", "T6"]["fraction"] == pytest.approx(want) and got["b", "T6"]["fraction"] == 1.0
    assert got["p", "T6"]["ci_low"] < want * 5 < got["p", "T6"]["ci_high"] and got["b", "T6"]["ci_low"] is None
    total = {r["book_key"]: r for r in totals.collect()}
    assert all(r["ci_low"] < r["total"] < r["ci_high"] for r in total.values())
    points = lambda key: sum(got[key, k]["fraction"] * got[key, k]["weight"] for k in ("T1", "T2", "T3", "T5", "T6"))
    assert {k: r["total"] for k, r in total.items()} == {k: pytest.approx(points(k) / 85 * 100) for k in "bp"} and total["p"]["total"] < total["b"]["total"]


def test_intervals_have_the_production_resamples():
    for f in (evaluate.score_books, evaluate.run_experiment):
        assert inspect.signature(f).parameters["resamples"].default == sampling.RESAMPLES >= 1000


def test_judges_give_up():
    class Mute:
        model = "gpt-5-mini"

        def complete(self, prompt, *, system=None):
            return connectors.Completion("SCORE: 9", 0, 0, 0.0, self.model)

    with pytest.raises(connectors.JudgeError):
        connectors.Judge(Mute()).meaning("a", "b")


def test_styles():
    assert styles.resolve_one("sl-SI") == "revise_sl" and styles.resolve_one("DE", context="device") == "baseline" and styles.resolve_one("x", requested="revise") == "revise"
    with pytest.raises(styles.StyleLanguageError):
        styles.resolve_one("de", requested="revise_sl")
    with pytest.raises(KeyError):
        styles.supports("none", "de")


def test_blank_lines_and_runs_of_white_space_survive_an_archive():
    texts = [("heading", "A  b"), ("paragraph", ""), ("paragraph", "one\u00a0two\tthree\r\nfour & <i>five</i>"), ("list_item", " x  y "), ("blockquote", "q  q"), ("other", "\x0c"), ("caption", "plain")]
    out = io.BytesIO()
    writer = epub.Writer({"book_key": "k", "title": "T", "authors": [], "language": "sl"}, {0: 1, 1: len(texts)}, out)
    for i, (chapter, kind, text) in enumerate([(0, "other", ""), *((1, *t) for t in texts)]):  # all of the first chapter is blank
        writer.row({"id": str(i), "type": kind, "text": text, "chapter_index": chapter, "chapter_title": f"c{chapter}", "heading_level": None})
    writer.close()
    found = list(epub.rows_of(out, "k", 1))
    assert [(r[2], r[3], r[4], r[6]) for r in found] == [("other", "", 0, 0), *((kind, text.strip(), 1, i) for i, (kind, text) in enumerate(texts, 1))]

import json

import pytest
from pyspark.sql import functions as F

from folioflux import __main__ as cli
from folioflux.operators import store
from folioflux.plans import connectors, memos, service
from folioflux.sources import books, epub
from tests.test_books import archive, small_book


def test_books_as_json_and_back(spark):
    raw = archive(["<h1>One</h1><p>Text</p><img src='f.png' alt='x'/>"], media=[("f.png", b"png")])
    files = spark.createDataFrame([("k", raw, ".epub")], "book_key string, content binary, suffix string")
    b, s, i = epub.books(files), epub.segments(files), epub.images(files)
    documents = books.to_json(b, s, i)
    back = books.from_json(documents)
    assert back[1].orderBy("position").collect() == s.select(*back[1].columns).orderBy("position").collect() and [bytes(r["data"]) for r in back[2].collect()] == [b"png"]
    old = json.loads(documents.first()["json"])
    del old["images"]
    for x in old["segments"]:
        del x["heading_level"]
    legacy = books.from_json(spark.createDataFrame([("k", json.dumps(old))], "book_key string, json string"))
    assert legacy[1].count() == 2 and legacy[2].count() == 0 and legacy[1].where("heading_level is not null").count() == 0


def test_paths_and_configuration(tmp_path, monkeypatch, spark):
    assert books.discover_source("x/Book.sl.epub", "sl", ["Book.pdf", "Book.mobi"]) == "Book.pdf" and books.discover_source("a.sl.epub", "sl", []) is None
    assert books.output_path("d/Book.pdf", "sl") == "d/Book.sl.epub"
    (tmp_path / ".env").write_text("# c\nFOLIOFLUX_MODEL='file'\nFOLIOFLUX_OTHER=1\n")
    monkeypatch.setenv("FOLIOFLUX_MODEL", "env")
    monkeypatch.setenv("FOLIOFLUX_LANG", "de")
    assert books.load_config({"model": "d", "lang": "sl", "n": 1}, str(tmp_path / ".env"), n=None) == {"model": "file", "lang": "de", "n": 1}
    assert books.load_config({"model": "d"}, model="given") == {"model": "given"}
    rows = books.mixed({"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([("s",)], "y string")})
    books.append_rows(rows, str(tmp_path / "out"))
    books.append_rows(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).groupBy("kind").count().collect() and spark.read.json(str(tmp_path / "out")).count() == 4


def test_memos_are_asked_for_once(spark, tmp_path):
    class Counting(connectors.EchoClient):
        calls = 0

        def complete(self, prompt, *, system=None):
            Counting.calls += 1
            return self._billed(prompt, 'Here: {"Sentence": "Stavek", " ": "x", "n": 3, "empty": ""}')

    cache, book = store.Store(spark, str(tmp_path / "c")), small_book(spark)
    for _ in range(2):
        assert memos.build_glossary(book, Counting(), cache, book_hash="h", lang="sl") == {"Sentence": "Stavek"}
        assert memos.build_memo(book, Counting(), cache, book_hash="h", lang="sl", prompt_version="v").startswith("Here")
    assert Counting.calls == 2 and cache.read("calls").count() == 2
    assert memos.parse_glossary("no json") == {} and memos.parse_glossary("{bad}") == {} and list(memos.parse_glossary('{"b": "1", "a": "2", "b": "3"}').items()) == [("b", "3"), ("a", "2")]
    assert memos.glossary_version() != memos.glossary_version(max_chars=1)


def test_screening(spark):
    class Screen(connectors.EchoClient):
        def complete(self, prompt, *, system=None):
            return self._billed(prompt, "YES" if "number 1" in prompt else "No, it isn't" if "number 2" in prompt else "hm")

    book = small_book(spark, 25).where("position in (1, 2, 10)")
    report = memos.screen_report(memos.screen(book, Screen), ["book_key"]).first()
    assert (report["total"], report["n_clean"]) == (3, 2) and report["cost_eur"] > 0
    with pytest.raises(Exception, match="neither yes nor no"):
        memos.screen(small_book(spark).where("position = 3"), Screen).collect()
    cost = memos.judge_cost(book, "gpt-5-mini").first()
    assert cost["calls"] == 12 and cost["cost_eur"] > 12 * 464 / 1e6 * 2 * 0.92


def test_push_and_pull(spark):
    at = lambda n: F.lit(n).cast("timestamp")
    shelves = spark.createDataFrame([("s1", "u"), ("s2", "u")], "id string, user_id string").withColumn("updated_at", at(100))
    items = spark.createDataFrame([("i1", "s1", "u"), ("i2", "s9", "u")], "id string, shelf_id string, user_id string").withColumn("updated_at", at(100))
    progress = spark.createDataFrame([("b", "u", "delete", 50.0), ("c", "u", "upsert", 120.0), ("d", "u", "upsert", 5.0)], "book_hash string, user_id string, op string, percent double").withColumn("updated_at", at(100))
    old = spark.createDataFrame([("s2", "u")], "id string, user_id string").withColumn("updated_at", at(200))
    out = service.push({"shelf_items": items, "shelves": shelves, "progress": progress}, {"shelves": old}, {"shelves": ["id"], "shelf_items": ["id"], "progress": ["book_hash"]}, {"progress": {"percent": F.col("percent").between(0, 100)}})
    assert list(out) == ["shelves", "progress", "shelf_items"]
    assert {r["id"]: r["status"] for r in out["shelves"].collect()} == {"s1": "applied", "s2": "conflict"}
    assert {r["id"]: (r["status"], r["error"]) for r in out["shelf_items"].collect()} == {"i1": ("applied", None), "i2": ("error", "missing_parent")}
    assert {r["book_hash"]: r["error"] for r in out["progress"].collect()} == {"b": "upsert_only", "c": "percent", "d": None}
    rows = service.pull(spark.createDataFrame([("u", i) for i in range(5)] + [("v", 9)], "user_id string, t long"), "u", ["t"], (1,), 2).collect()
    assert [(r["t"], r["more"]) for r in rows] == [(2, False), (3, False), (4, True)]


def test_public_reader(spark):
    profiles = spark.createDataFrame([("u", "ann", "Ann", True), ("v", "bob", "Bob", False)], "user_id string, handle string, display_name string, is_public boolean")
    shelves = spark.createDataFrame([("s1", "u", "Read", "read", True, None), ("s2", "u", "Secret", "custom", False, None), ("s3", "u", "Gone", "custom", True, "x")], "id string, user_id string, name string, kind string, is_public boolean, deleted_at string")
    items = spark.createDataFrame([("s1", "T", "A", None), ("s2", "U", "A", None)], "shelf_id string, title string, authors string, deleted_at string")
    ratings = spark.createDataFrame([("u", "T", 5, "good", True, None)], "user_id string, title string, stars int, review string, is_public boolean, deleted_at string")
    passages = spark.createDataFrame([("p1", "u", "T", "one", 1, True, None), ("p2", "u", "T", "two", 2, True, None)], "id string, user_id string, title string, excerpt string, created_at long, is_public boolean, deleted_at string")
    r = service.public_reader(profiles, shelves, items, ratings, passages, "ann").first()
    assert [(s["name"], [i["title"] for i in s["items"]]) for s in r["shelves"]] == [("Read", ["T"])] and r["ratings"][0]["stars"] == 5 and [p["id"] for p in r["passages"]] == ["p2", "p1"]
    assert service.public_reader(profiles, shelves, items, ratings, passages, "bob").count() == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(archive(["<h1>One</h1><p>First text.</p><p>Second text.</p>"]))
    for verb in ("inspect", "estimate", "catalog"):
        assert cli.main([verb, str(tmp_path / "in")]) == 0
    assert "The Book" in capsys.readouterr().out
    target = tmp_path / "out.epub"
    assert cli.main(["translate", str(tmp_path / "in"), "--cache", str(tmp_path / "cache"), "--output", str(target)]) == 0
    _, segments, _ = epub.read_book(target.read_bytes(), "a")
    assert len(segments) == 3 and segments[1][3].endswith("First text.")
    capsys.readouterr()
    assert cli.main(["inspect", str(tmp_path / "in"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out.strip())["n_segments"] == 3
    assert cli.main(["eval", str(target), "--source", str(tmp_path / "in" / "a.epub"), "--json"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert {x["key"]: x["fraction"] for x in lines if "key" in x}["T1"] == 1.0 and 0 < lines[-1]["total"] <= 100
    assert cli.main(["doctor", "--cache", str(tmp_path / "cache")]) == 0 and "ok   model" in capsys.readouterr().out
    assert cli.main(["doctor", "--cache", str(tmp_path / "cache"), "--model", "unheard-of"]) == 1


def test_back_matter_is_left_untranslated_only_on_request(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(archive(["<h1>Story</h1><p>First text.</p>", "<h1>Notes</h1><p>A note.</p>"]))
    got = {}
    for how in ([], ["--skip-back-matter"]):
        target = tmp_path / f"out{len(how)}.epub"
        assert cli.main(["translate", str(tmp_path / "in"), "--cache", str(tmp_path / f"cache{len(how)}"), "--output", str(target), *how]) == 0
        got[len(how)] = [s[3] for s in epub.read_book(target.read_bytes(), "a")[1]]
    assert got[0][3] != "A note." and got[1][3] == "A note." and got[0][1] == got[1][1] != "First text."

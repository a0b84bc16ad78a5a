from datetime import datetime

from folioflux.llm.url_filter import filter_urls, list_intervals

T = "list_name string, kind string, entry string, action string, listed_at timestamp"


def day(n):
    return datetime(2024, 1, n)


def run(spark, captures, entries):
    c = spark.createDataFrame(captures, "id long, url string, fetched_at timestamp, url_filter string")
    found = filter_urls(c, spark.createDataFrame(entries, T)).collect()
    return sorted([(r["id"] is None, r["id"], r["url_filter"]["host"], r["url_filter"]["decision"], r["url_filter"]["entry"], r["url_filter"]["n_active"]) for r in found], key=str)


def test_entries_hold_from_their_date_to_the_next(spark):
    entries = [("a", "domain", "x.com", "block", day(5)), ("a", "domain", "x.com", "remove", day(10)), ("a", "domain", "X.com ", "block", day(15)), ("a", "domain", "x.com", "block", day(15))]
    rows = list_intervals(spark.createDataFrame(entries, T)).orderBy("valid_from").collect()
    assert [(r["valid_from"], r["valid_to"]) for r in rows] == [(day(5), day(10)), (day(15), None)]
    captures = [(i, "http://www.X.com/a", day(i), "old") for i in (4, 5, 9, 10, 14, 15, 20)]
    assert [(i, d) for _, i, _, d, _, _ in sorted(run(spark, captures, entries), key=lambda r: r[1])] == [(4, "pass"), (5, "block"), (9, "block"), (10, "pass"), (14, "pass"), (15, "block"), (20, "block")]


def test_the_most_specific_entry_decides_and_ties_go_to_block(spark):
    entries = [
        ("a", "domain", "x.com", "block", day(1)), ("b", "host", "ok.x.com", "allow", day(1)), ("c", "prefix", "ok.x.com/bad/", "block", day(1)), ("d", "prefix", "ok.x.com/bad/", "allow", day(1)), ("e", "prefix", "ok.x.com/b", "allow", day(1)),
    ]
    captures = [(1, "https://ok.x.com/", day(2), ""), (2, "https://ok.x.com/bad/1?q#f", day(2), ""), (3, "https://ok.x.com/bad", day(2), ""), (4, "https://u:p@sub.x.com:8080", day(2), ""), (5, "https://notx.com/", day(2), "")]
    got = {r[1]: (r[2], r[3], r[4]) for r in run(spark, captures, entries)}
    assert got == {1: ("ok.x.com", "allow", "ok.x.com"), 2: ("ok.x.com", "block", "ok.x.com/bad/"), 3: ("ok.x.com", "allow", "ok.x.com/b"), 4: ("sub.x.com", "block", "x.com"), 5: ("notx.com", "pass", None)}


def test_nulls_repeats_and_empty_tables(spark):
    entries = [("a", "domain", "x.com", "block", day(1)), (None, "domain", "y.com", "block", day(1)), ("a", "other", "y.com", "block", day(1)), ("a", "domain", "y.com", "maybe", day(1)), ("a", "domain", "y.com", "block", None)]
    captures = [(1, None, day(2), ""), (2, "relative/path", day(2), ""), (3, "http://x.com", None, ""), (4, "http://y.com", day(2), ""), (5, "http://x.com", day(2), ""), (5, "http://x.com", day(2), ""), (None, "", day(2), None)]
    got = run(spark, captures, entries)
    assert len(got) == 7 and sorted((str(r[1]), r[3]) for r in got) == [("1", "pass"), ("2", "pass"), ("3", "pass"), ("4", "pass"), ("5", "block"), ("5", "block"), ("None", "pass")]
    assert run(spark, [], entries) == []
    assert [r[3] for r in run(spark, [(1, "http://x.com", day(2), "")], [])] == ["pass"]

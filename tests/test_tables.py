import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflux.functions import identity
from folioflux.operators import experiment, sampling, scoring, segments, selection, store, sync


def test_replay_is_the_loop_and_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    log = [(rng.randrange(8), i, rng.randrange(20), rng.choice(["upsert", "upsert", "delete", "undelete", "other"]), rng.random()) for i in range(400)]
    df = spark.createDataFrame(log, "k int, arrival long, updated_at long, op string, v double")
    want = {}
    for k, _, at, op, v in log:
        s = want.setdefault(k, [None, None, False, 0, 0])
        if op in ("upsert", "delete", "undelete") and (s[1] is None or at >= s[1]) and not (s[2] and op == "upsert"):
            want[k] = [v, at, op == "delete", s[3] + 1, s[4]]
        else:
            s[4] += 1
    for n in (1, 7, 64):
        got = {r["k"]: [r["v"], r["updated_at"], r["deleted"], r["n_applied"], r["n_conflicts"]] for r in sync.replay(df.repartition(n), ["k"], ["v"]).collect()}
        assert got == want


def test_paging_drains_everything_once(spark):
    rows = spark.createDataFrame([(i // 7, i) for i in range(50)], "t long, id long")
    cursors = sync.drain(rows, ["t", "id"], 8)
    assert len(cursors) == 7 and cursors[-1] == (7, 49)
    first = sync.page(rows, ["t", "id"], None, 8).collect()
    assert [r["id"] for r in first] == list(range(9)) and [r["more"] for r in first] == [False] * 8 + [True]
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            sync.page(rows, ["t", "id"], None, bad)


def test_stream_is_batch(spark, tmp_path):
    from folioflux.streaming import sync as streaming

    rng = random.Random(2)
    schema = "k int, arrival long, updated_at long, op string, v double"
    log = [(rng.randrange(5), i, i - rng.randrange(30), rng.choice(["upsert", "delete", "undelete"]), rng.random()) for i in range(200)]
    for n in range(4):
        spark.createDataFrame(log[n * 50 : n * 50 + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = streaming.latest_state(streaming.stream_of(spark, str(tmp_path / "log"), schema), ["k"], ["v"])
    query = streaming.drain(stream, "states", str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    states = {}
    for r in spark.table("states").collect():
        if r["k"] not in states or r["n_applied"] + r["n_conflicts"] > states[r["k"]]["n_applied"] + states[r["k"]]["n_conflicts"]:
            states[r["k"]] = r
    batch = {r["k"]: r for r in sync.replay(spark.createDataFrame(log, schema), ["k"], ["v"]).collect()}
    assert {k: (r["v"], r["updated_at"], r["deleted"], r["n_applied"]) for k, r in states.items()} == {k: (r["v"], r["updated_at"], r["deleted"], r["n_applied"]) for k, r in batch.items()}


def test_store_appends_once_replaces_and_migrates(spark, tmp_path):
    cache = store.Store(spark, str(tmp_path / "cache"))
    row = lambda h, text, at=1.0, version="v": ("b", h, "m", "sl", version, "g", text, 0.1, at)
    new = spark.createDataFrame([row("1", "b"), row("1", "a"), row("2", "x")], store.SCHEMAS["translations"])
    cache.append("translations", new, "text")
    cache.append("translations", new.withColumn("text", F.lit("other")), "text")
    assert {(r["segment_hash"], r["text"]) for r in cache.read("translations").collect()} == {("1", "a"), ("2", "x")}
    memo = lambda text, at: spark.createDataFrame([("b", "m", "sl", "v", text, at)], store.SCHEMAS["book_contexts"])
    for text, at in (("one", 1.0), ("three", 3.0), ("two", 2.0)):
        cache.replace("book_contexts", memo(text, at))
    assert [r["memo"] for r in cache.read("book_contexts").collect()] == ["three"] and cache.read("calls").count() == 0
    old = spark.createDataFrame([("b", "1", "m", "sl", "t", 0.0, 1.0), ("c", "1", "m", "sl", "t", 0.0, 1.0)], "book_hash string, segment_hash string, model string, lang string, text string, cost_eur double, created_at double")
    glossaries = spark.createDataFrame([("b", "m", "sl", "v", '{"x": "1"}', 1.0), ("b", "m", "sl", "w", '{"y": "2"}', 2.0)], store.SCHEMAS["glossaries"])
    wide = store.migrate_translations(old, glossaries, F.when(F.col("terms_json").isNotNull(), identity.glossary_identity(F.from_json("terms_json", "map<string,string>"))))
    got = {r["book_hash"]: (r["prompt_version"], r["glossary_hash"]) for r in wide.collect()}
    assert got["c"] == (store.BASELINE_VERSION, store.EMPTY_GLOSSARY) and got["b"][1] not in (store.EMPTY_GLOSSARY, None)
    assert store.facts(spark.createDataFrame([], store.SCHEMAS["calls"]), glossaries, "b", "m", "sl") == ({"y": "2"}, None)


def test_sqlite_cache_is_read(spark, tmp_path):
    path = str(tmp_path / "c.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE translations (book_hash TEXT, segment_hash TEXT, model TEXT, lang TEXT, text TEXT, cost_eur REAL, created_at REAL)")
        db.execute("INSERT INTO translations VALUES ('b', 's', 'm', 'sl', 'hej', 0.5, 2.0)")
    rows = store.from_sqlite(spark, path, "translations").collect()
    assert [(r["text"], r["prompt_version"], r["cost_eur"]) for r in rows] == [("hej", None, 0.5)] and store.from_sqlite(spark, path, "calls").count() == 0


def book(spark, n, types="paragraph", key="b"):
    rows = [(key, i // 10, f"Chapter {i // 10}", i, types if isinstance(types, str) else types[i % len(types)], None, f"some text number {i} with words", f"{key}{i}") for i in range(n)]
    return spark.createDataFrame(rows, "book_key string, chapter_index int, chapter_title string, position long, type string, heading_level int, text string, id string")


def test_alignment_truncates_and_refuses(spark):
    whole = book(spark, 40, ("paragraph", "heading", "list_item"))
    same = scoring.align(whole, whole).collect()
    assert all(r["position"] == r["target_position"] for r in same) and len(same) == 40
    cut = scoring.align(whole, whole.where("position < 33")).orderBy("position").collect()
    assert [r["target_position"] for r in cut] == [*range(33), *[None] * 7]
    with pytest.raises(Exception, match="match nothing"):
        scoring.align(whole.where("position < 33"), whole).collect()
    assert scoring.completeness(scoring.align(whole, whole.where("position < 20"))).first()["fraction"] == 0.5
    assert scoring.mismatches(whole, whole.where("position <> 7")).first()["first_position"] == 7 and scoring.mismatches(whole, whole).count() == 0


def test_totals_skip_what_is_null_and_cap_what_is_incomplete(spark):
    rows = [("x", "T1", 1.0), ("x", "T2", 0.5), ("x", "T4", None), ("y", "T1", 0.9), ("y", "T2", 1.0), ("z", "T4", None)]
    got = {r["book_key"]: r["total"] for r in scoring.weighted_total(spark.createDataFrame(rows, "book_key string, key string, fraction double")).collect()}
    assert got == {"x": 70.0, "y": 40.0, "z": 0.0}


def test_bootstrap(spark):
    assert sampling.select_indices(5, 9, 1) == [0, 1, 2, 3, 4] and sampling.select_indices(100, 5, 42) == sorted(random.Random(42).sample(range(100), 5))
    rng = np.random.default_rng(0)
    values = rng.normal(size=30)
    stats = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    r = sampling.interval(stats, "v", ["g"]).first()
    assert (r["ci_low"], r["ci_high"]) == pytest.approx((np.quantile(values, 0.025), np.quantile(values, 0.975)))
    items = spark.createDataFrame([("g", i, float(i)) for i in range(10)], "g string, index long, v double")
    means = [r["v"] for r in sampling.resampled_means(items, ["g"], ["v"], seed=1, resamples=400).collect()]
    assert len(means) == 400 and abs(np.mean(means) - 4.5) < 0.2 and 0.7 < np.std(means) < 1.1
    a, b = sampling.generator_draws(spark, [3, 2], seed=9, resamples=4)
    stream = random.Random(9)
    want = [[stream.randrange(n) for _ in range(n)] for _ in range(4) for n in (3, 2)]
    got = [[r["index"] for r in sorted(d.collect()) if r["resample"] == k] for k in range(4) for d in (a, b)]
    assert got == want


def test_runs_are_tiled_with_room_between(spark):
    rows = book(spark, 30).withColumn("type", F.when(F.col("position") == 14, "heading").otherwise("paragraph"))
    controls = rows.select("book_key", "id", F.col("text").alias("control"))
    runs = experiment.candidate_runs(experiment.eligible_blocks(rows, controls), run_length=3, context_pairs=2)
    assert sorted({r["run"] for r in runs.collect()}) == [0, 5, 10, 15, 20, 25]
    leads = {(r["run"], r["back"]): r["id"] for r in experiment.lead_ins(runs, rows, controls, context_pairs=2).collect()}
    assert leads == {(5, 1): "b4", (5, 2): "b3", (15, 1): "b14", (15, 2): "b13", (25, 1): "b24", (25, 2): "b23"}
    with pytest.raises(ValueError):
        experiment.candidate_runs(runs, run_length=0, context_pairs=2)
    seeds = experiment.seed_rows(runs, experiment.lead_ins(runs, rows, controls, context_pairs=2), "c", "v").collect()
    assert sum(r["prompt_version"] == "v" for r in seeds) == 6


def test_selection_meets_sizes_and_floors(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 5}", i, i, rng.choice(["short", "medium", "long"]), [s for s in ("digits", "quotes", "hyphen_break") if rng.random() < (0.4 if s != "hyphen_break" else 0.02)]) for i in range(600)]
    df = spark.createDataFrame(rows, "book_slug string, chapter_index int, position long, band string, strata array<string>")
    chosen = selection.select(df, "smoke").collect()
    assert len(chosen) == 40 and min(sum(r["book_slug"] == s for r in chosen) for s in {r[0] for r in rows}) >= 4
    assert sum("hyphen_break" in r["strata"] for r in chosen) >= 2
    assert sorted(map(str, chosen)) == sorted(map(str, selection.select(df.repartition(5), "smoke").collect()))
    assert selection.allot({"a": 100, "b": 10, "c": 1}, 12, 3) == {"a": 6, "b": 3, "c": 3} and sum(selection.allot({"a": 7, "b": 7, "c": 7}, 20, 1).values()) == 20
    again = selection.verify(df.select("book_slug", "chapter_index", "position", F.lit("h").alias("segment_hash")), df.where("position > 3").select("book_slug", "chapter_index", "position", F.when(F.col("position") == 9, "x").otherwise("h").alias("segment_hash")))
    assert sorted((r["position"], r["problem"]) for r in again.collect()) == [(0, "missing"), (1, "missing"), (2, "missing"), (3, "missing"), (9, "changed")]


def test_body_pool_falls_back(spark):
    rows = book(spark, 40)
    excluded = spark.createDataFrame([("b", 0)], "book_key string, chapter_index int")
    assert segments.restrict_to_body(rows, excluded, 30).count() == 30 and segments.restrict_to_body(rows, excluded, 31).count() == 40


def test_violations_and_orphans(spark):
    rows = spark.createDataFrame([(1, 5, None), (2, 9, "a"), (3, None, "b")], "id int, stars int, parent string")
    assert [(r["id"], r["check"]) for r in sync.violations(rows, ["id"], {"stars": F.col("stars") <= 5}).collect()] == [(2, "stars")]
    assert {r["id"] for r in sync.orphans(rows, spark.createDataFrame([("a",)], "k string"), "parent", "k").collect()} == {1, 3}


def kinds_of(spark, key, kinds):
    rows = [(key, 0, "C", i, k, 1 if k == "heading" else None, f"{key} text {i}", f"{key}{i}") for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "book_key string, chapter_index int, chapter_title string, position long, type string, heading_level int, text string, id string")


def test_a_book_without_target_rows_is_scored(spark):
    source = kinds_of(spark, "s", ["heading", "paragraph", "list_item"]).unionByName(kinds_of(spark, "z", ["heading", "paragraph", "list_item"]))
    target = source.where("book_key = 's'")
    pairs = scoring.align(source, target)
    assert {r["book_key"]: r["fraction"] for r in scoring.completeness(pairs).collect()} == {"s": 1.0, "z": 0.0}
    scores = {r["book_key"]: r for r in scoring.structure(source, target).collect()}
    assert scores["s"]["fraction"] == 1.0 and (scores["z"]["chapter_score"], scores["z"]["heading_score"], scores["z"]["block_score"], scores["z"]["emphasis_score"]) == (0.0, 0.0, 1.25, 2.5)


def test_alignment_of_equal_books_is_by_number(spark):
    source = kinds_of(spark, "s", ["heading", *["paragraph"] * 30])
    target = source.withColumn("position", F.col("position") * 3 + 5).withColumn("text", F.upper("text"))
    rows = scoring.align(source, target).collect()
    assert len(rows) == 31 and all(r["target_position"] == r["position"] * 3 + 5 and r["target_text"] == r["text"].upper() for r in rows)


def test_a_glossary_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_TERMS", 2)
    terms = spark.createDataFrame([(f"t{i}", "r") for i in range(3)], "term string, rendering string")
    with pytest.raises(ValueError, match="more than 2"):
        scoring.terminology(spark.createDataFrame([("a", "b")], "text string, target_text string"), terms)


def test_band_quotas_are_allotted_book_by_book(spark):
    rng = random.Random(3)
    rows = [(f"b{rng.randrange(6)}", rng.choices(["short", "medium", "long"], [1, 5, 9])[0]) for _ in range(300)] + [("tiny", "long")] * 2
    quotas = {f"b{i}": 3 + 4 * i for i in range(6)} | {"tiny": 12}
    got = selection.band_quotas(spark.createDataFrame(rows, "book_slug string, band string"), spark.createDataFrame(list(quotas.items()), "book_slug string, quota int")).collect()
    for slug, quota in quotas.items():
        counts = {b: sum(r == (slug, b) for r in rows) for b in ("short", "medium", "long")}
        wanted = selection.allot({b: n for b, n in counts.items() if n}, quota, 1)
        assert {r["band"]: r["quota"] for r in got if r["book_slug"] == slug} == wanted
        assert sum(wanted.values()) == quota  # in proportion, not bounded by what a band has


def test_running_sums_of_one_book_with_nearly_all_rows(spark):
    from folioflux.operators.running import running_totals

    rows = [("hot" if i % 50 else f"g{i % 7}", i, i % 5 or None) for i in range(10_000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(8)
    got = {r["o"]: (r["s"], r["n"]) for r in running_totals(df, ["g"], ["o"], {"s": F.col("v"), "n": F.lit(1)}, range_rows=50).collect()}
    sums, counts = {}, {}
    for g, o, v in rows:
        assert got[o] == (sums.get(g, 0), counts.get(g, 0))
        sums[g], counts[g] = sums.get(g, 0) + (v or 0), counts.get(g, 0) + 1

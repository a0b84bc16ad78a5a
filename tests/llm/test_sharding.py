import zlib
from collections import Counter

import pytest

from folioflux.llm import sharding


def check(rows, shards, sizes=None):
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(0 <= r["shard"] < shards for r in rows)


def test_bytes_are_nearly_equal_and_every_row_is_there(spark):
    docs = [(i, f"text {i} " + "x" * (i * 7919 % 400)) for i in range(3000)]
    rows = sharding.histogram_shards(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    check(rows, 8)
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    assert all(r["size"] == len(r["text"].encode()) + 16 and r["text_crc32"] == zlib.crc32(r["text"].encode()) for r in rows)
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    ideal = sum(total.values()) / 8
    assert max(abs(n - ideal) for n in total.values()) <= 2 * 0.01 * ideal + 450


def test_a_group_of_copies_is_divided_and_small_groups_stay_together(spark):
    docs = [(i, "the same text") for i in range(1000)] + [(1000 + i, f"own {i // 2}") for i in range(2000)]
    rows = sharding.histogram_shards(spark.createDataFrame(docs, "doc_id long, text string"), 10).collect()
    check(rows, 10)
    assert len({r["shard"] for r in rows if r["doc_id"] < 1000}) >= 3
    pairs = Counter((r["text"], r["shard"]) for r in rows if r["doc_id"] >= 1000)
    assert sum(n == 1 for n in pairs.values()) <= 2 * 9
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    assert max(total.values()) - min(total.values()) <= 2 * (0.02 * sum(total.values()) / 10 + 60)


def test_edge_rows(spark):
    docs = [(None, None, "a"), (None, None, "a"), (1, "", "b"), (2, "é" * 100000, "c"), (3, "x", None), (3, "x", None)]
    rows = sharding.histogram_shards(spark.createDataFrame(docs, "doc_id long, text string, shard string"), 4).collect()
    check(rows, 4)
    assert len(rows) == 6 and sorted(r["size"] for r in rows) == [16, 16, 16, 17, 17, 200016]
    assert [r["text_crc32"] for r in rows if r["text"] is None] == [None, None]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.histogram_shards(empty, 4).count() == 0
    assert {r["shard"] for r in sharding.histogram_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 1).collect()} == {0}


def test_shards_are_written_in_slot_order(spark, tmp_path):
    rows = sharding.histogram_shards(spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id long, text string"), 3)
    sharding.write_shards(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 3


@pytest.mark.parametrize("n", [1, 2, 5])
def test_shard_of_counts_boundaries_not_above(spark, n):
    bounds = sorted((k * 10, k) for k in range(n))
    df = spark.createDataFrame([(k, j) for k in (-5, 0, 5, 10, 40, 99) for j in (-1, 0, 1, 4)], "__k1 long, __k2 long")
    for r in df.select("*", sharding.shard_of(bounds).alias("s")).collect():
        assert r["s"] == sum(b <= (r["__k1"], r["__k2"]) for b in bounds)


@pytest.mark.parametrize("copies", [0, 300, 1500])
def test_slots_are_in_key_order_whatever_the_cells(spark, copies):
    docs = [(i, "hot" if i < copies else "warm" if i < copies * 1.2 else f"text {i // 2}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    keyed = {r[0]: (r[1], r[2]) for r in df.selectExpr("doc_id", "xxhash64(text)", "xxhash64(doc_id)").collect()}
    one = sharding.histogram_shards(df, 4, cell_rows=1 << 30).collect()
    for cell_rows in (10, 100):
        many = sharding.histogram_shards(df, 4, cell_rows=cell_rows).collect()
        check(many, 4)
        place = lambda rows: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)
        assert place(one) == place(many)
    in_order = [r["doc_id"] for r in sorted(one, key=lambda r: (r["shard"], r["slot"]))]
    assert in_order == sorted(keyed, key=keyed.get)


def test_clashing_columns(spark):
    names = ["doc_id", "text", "__k1", "__k2", "row", "cell", "prefix", "copies", "nth", "offset", "size", "a.b"]
    df = spark.createDataFrame([(i, f"t{i}", *[f"{n}{i}" for n in names[2:]]) for i in range(50)], names)
    for cell_rows in (4096, 3):
        rows = sharding.histogram_shards(df, 3, cell_rows=cell_rows).collect()
        check(rows, 3)
        assert len(rows) == 50 and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names[2:] if n != "size") and all(r["size"] == 16 + len(r["text"]) for r in rows)


def test_query_is_brute_force(spark):
    """The law and the slots of the registered query, from the texts themselves."""
    from folioflux.llm import queries
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op2_sharding(spark, f"{DATA}/sf0.001").collect()}
    order = docs.selectExpr("doc_id", "text", "xxhash64(text) a", "xxhash64(doc_id) b").orderBy("a", "b").collect()
    assert len(order) == len(got) == docs.count()
    sizes = [len(r["text"].encode()) + 16 for r in order]
    wanted, slots, before = sum(sizes) / queries.SHARDS, Counter(), 0
    for r, size in zip(order, sizes, strict=True):
        g = got[r["doc_id"]]
        assert (g["size"], g["text_crc32"], g["law"], g["grown_shard"]) == (size, zlib.crc32(r["text"].encode()), "bytes", None)
        # a row lies in the shard that its bytes before belong to, as far as tolerance and its own size allow
        assert before - 0.01 * wanted - max(sizes) <= (g["shard"] + 1) * wanted and before + size + 0.01 * wanted + max(sizes) >= g["shard"] * wanted
        assert g["slot"] == slots[g["shard"]]
        slots[g["shard"]] += 1
        before += size

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioflux.llm import residual_pack, token_pack
from folioflux.llm.queries import tokenizer_path
from folioflux.llm.shared import new_folder
from folioflux.llm.tokenizing import Ids

TEXTS = ["", "hello world", "  a\n\n b ", "<|endoftext|> inside", "naïve café 😀 ﷽ ​", "x" * 3000, "word " * 2500, "a\x00b", "it's I'LL we've", "1234567 89", "\t\t \r\n end  "]


@pytest.fixture(scope="module")
def coder():
    return Ids(tokenizer_path())


def test_ids_are_those_of_tokenizers(coder):
    slow = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(2)
    more = ["".join(rng.choice("ab éßA1 .,'\n\t-😀漢") for _ in range(rng.randrange(200))) for _ in range(300)]
    assert coder.fast is not None
    for t in [*TEXTS, *more]:
        assert coder.encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_cuts_leave_only_the_first_piece_short():
    assert residual_pack.cuts(10, 10) == [(0, 10)] and residual_pack.cuts(20, 10) == [(0, 10), (10, 10)] and residual_pack.cuts(23, 10) == [(0, 3), (3, 10), (13, 10)] and residual_pack.cuts(1, 10) == [(0, 1)]


def test_best_fit_is_the_plain_loop():
    rng = random.Random(1)
    for _ in range(30):
        lengths = np.array([rng.randrange(1, 51) for _ in range(rng.randrange(1, 120))])
        bins, offsets, fill = residual_pack.best_fit(lengths, 50)
        rooms: list[int] = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in rooms if r >= lengths[i]]
            room = min(fits) if fits else 50
            if fits:
                rooms.remove(room)
            rooms.append(room - int(lengths[i]))
        assert sorted(50 - r for r in rooms) == sorted(fill[fill > 0].tolist())
        for b in set(bins.tolist()):
            own = sorted((int(offsets[i]), int(lengths[i])) for i in np.flatnonzero(bins == b))
            assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()


def packed_rows(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string, piece string")
    return residual_pack.pack_documents(df, tokenizer_path(), with_ids=True, **how).collect()


@pytest.mark.parametrize("node_items", [50_000, 40])
def test_sequences_are_gapless_and_give_the_documents_back(spark, coder, node_items):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["the", "of", "syllable", "zq"]) for _ in range(rng.randrange(0, 120))), "x") for i in range(400)] + [(1000 + i, t, None) for i, t in enumerate(TEXTS)] + [(2000, None, ""), (2001, "twice", ""), (2001, "twice", "")]
    rows = packed_rows(spark, docs, capacity=64, node_items=node_items)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"] <= 256
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    texts = defaultdict(list)
    for r in rows:
        if r["doc_id"] != 2001:
            texts[r["doc_id"]].append(r)
    for doc, text, _ in docs:
        if doc != 2001:
            own = sorted(texts[doc], key=lambda r: r["piece"])
            ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4")
            assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
            assert ids[-1] == 2 and ids[:-1].tolist() == coder.encode(text or "").tolist() and all(r["length"] == 64 for r in own[1:])
    assert sum(r["doc_id"] == 2001 for r in rows) == 2
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // 64) * (1.02 if node_items > 1000 else 1.06) + 2


def test_underfull_bins_of_many_nodes_are_merged(spark):
    items = spark.createDataFrame([(i, 10) for i in range(103)], "uid long, length long")
    bins = residual_pack.pack_lengths(items, 100, node_items=7).groupBy("sequence_id").count().collect()
    assert sum(r["count"] for r in bins) == 103 and max(r["count"] for r in bins) <= 10 and len(bins) <= 14
    assert residual_pack.pack_lengths(items.where("false"), 100).count() == 0


def test_no_documents(spark):
    assert packed_rows(spark, []) == []
    assert token_pack.pack_tokens(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


# ---- matrices


def test_capacity_tree_is_best_fit():
    rng = random.Random(5)
    for capacity in (1, 7, 64, 100):
        tree, rooms = token_pack.CapacityTree(capacity), []
        for k in range(500):
            need = rng.randrange(1, capacity + 1)
            if rng.random() < 0.5:
                tree.put(need, k)
                rooms.append(need)
            else:
                fits = [r for r in rooms if r >= need]
                found = tree.take(need)
                assert (found is None) == (not fits) and (found is None or found[0] == min(fits))
                if found:
                    rooms.remove(found[0])


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_matrices_give_the_documents_back(spark, coder, chunk, monkeypatch):
    monkeypatch.setattr(token_pack, "OPEN_ROWS", 3)
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["the", "of", "tree"]) for _ in range(rng.randrange(0, 90)))) for i in range(200)] + [(500 + i, t) for i, t in enumerate(TEXTS)] + [(900, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, ids string").repartition(2)
    packed = token_pack.pack_tokens(df, tokenizer_path(), capacity=50, chunk_tokens=chunk)
    rows = packed.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    parts = defaultdict(list)
    for r in rows:
        ids, positions = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u4")
        assert len(ids) == len(positions) == 50 and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == 50256).all() and (positions[r["n_tokens"] :] == 0).all()
        for k, (a, b) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False)):
            assert positions[a:b].tolist() == list(range(b - a))
            parts[r["doc_ids"][k]].append((r["starts"][k], r["pieces"][k], ids[a:b].tolist()))
    for doc, text in docs:
        own = sorted(parts[doc])
        flat = [x for _, _, ids in own for x in ids]
        assert [p for _, p, _ in own] == list(range(len(own))) and flat == [*coder.encode(text or "").tolist(), 50256]
    folder = new_folder(spark, "matrices")
    listed = token_pack.write_matrices(packed, folder).collect()
    assert sum(r["n_rows"] for r in listed) == len(rows) and sum(r["n_segments"] for r in listed) == sum(len(r["doc_ids"]) for r in rows)
    path = folder.removeprefix("file:")
    first = listed[0]
    ids = np.fromfile(f"{path}/{first['name']}.ids", "<u2").reshape(first["n_rows"], 50)
    index, lengths = np.fromfile(f"{path}/{first['name']}.index", "<u8"), np.fromfile(f"{path}/{first['name']}.cu_seqlens", "<u4")
    assert len(index) == first["n_rows"] + 1 and index[-1] == len(lengths) and ids.shape[1] == 50


def test_rounds_go_on_while_any_bin_is_merged(spark):
    small = set(random.Random(0).sample(range(2500), 24))
    items = spark.createDataFrame([(i, 400 if i in small else 600) for i in range(2500)], "uid long, length long")
    assert residual_pack.pack_lengths(items, 1000, node_items=1).select("sequence_id").distinct().count() == 2500 - 24

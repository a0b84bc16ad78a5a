import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioflux.llm import bytewords as bw

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = [(bw.BLANK_SEPARATED, re.compile("[^\x20\x09-\x0d]+")), (bw.ALPHANUMERIC, re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"))]


def texts():
    rng = random.Random(3)
    alphabet = "abAB 0\t\n\x0b\x1f\x85\xa0é€😀.-\x00\x01"
    return [None, "", " ", "\n\n", "a", "\x00 \x01", *["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(200)], "x" * 5000, "ab " * 4000]


@pytest.mark.parametrize("segment", [1 << 20, 256])
@pytest.mark.parametrize(("table", "pattern"), PATTERNS)
def test_words_are_those_of_the_pattern(monkeypatch, segment, table, pattern):
    monkeypatch.setattr(bw, "SEGMENT", segment)
    rows = texts()
    data, offsets = bw.buffers(pa.array(rows, pa.string()))
    hashes, begins, bounds = bw.words(data, offsets, table)
    names: dict[int, str] = {}
    for i, t in enumerate(rows):
        found = pattern.findall((t or "").translate(LOW))
        own = hashes[bounds[i] : bounds[i + 1]].tolist()
        assert len(own) == len(found)
        for h, w in zip(own, found, strict=True):
            assert names.setdefault(h, w) == w
        for b, w in zip(begins[bounds[i] : bounds[i + 1]].tolist(), found, strict=True):
            assert data[b : b + len(w.encode())].tobytes().decode().translate(LOW) == w
    assert len(set(names.values())) == len(names)


def test_slices_cover_all_rows_and_respect_offsets():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "", "cc"])], ["text"]).slice(1)
    parts = list(bw.slices(batch, "text", 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [None, "b" * 50, "", "cc"]
    data, offsets = bw.buffers(parts[-1].column(0))
    assert len(offsets) == parts[-1].num_rows + 1 and offsets[0] == 0 and data.tobytes().decode() == "".join(x or "" for x in parts[-1].column(0).to_pylist())


def test_powers_are_inverse():
    up, down = bw.powers(5000)
    assert (up * down == 1).all() and up[1] == np.uint64(0x9E3779B97F4A7C15)

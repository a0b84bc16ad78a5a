"""Language-model scoring with a compact n-gram trie of Elias-Fano sequences.

Tokens are words between blanks (A-Z lower-cased) and one end after each text. The trie's first level is the vocabulary: sorted
64-bit hashes of the training tokens with their counts; a token's id is its rank. Each further level holds, for every n-gram of the
level above in order, the ids that follow it often enough: monotone pointers to where an n-gram's successors begin, the successors'
ids made monotone by adding the last number of the n-gram before (both as Elias-Fano sequences), and quantised smoothed
probabilities. A successor is found relative to its context: by one search in the context's part of the sequence.

Building: every level is counted over all training texts. Tasks combine what they have counted before anything is shuffled and send
sorted, compressed runs to the parts of a level, which are ranges of contexts of bounded weight; each part is merged by one task and
written as one file in the shared folder. A context that outweighs a part, as a frequent word does, is merged in two levels: ranges of
its successors by a task each, which leave one run in the shared folder, and these by one task, which then holds each distinct
successor once. What comes to the driver is a few numbers for each file; the index of a level's files is a file itself. Scoring maps
the files into memory, so that all workers of a machine share one copy, and reads what their texts need.

Smoothing is interpolated absolute discounting: P(w | context) = max(c - D, 0) / c(context) + rest * P(w | shorter context), with the
rest of the mass as weight, down to unigrams and a uniform share for all known tokens and one unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflux.llm import bytewords as bw
from folioflux.llm.columns import with_text_column
from folioflux.llm.elias_fano import EliasFano, map_arrays, pack_arrays
from folioflux.llm.shared import bound_batches, delete_files, local_path, new_folder, read_file, write_file

DISCOUNT = 0.75
#: n-grams of two and more tokens are kept from this count on: all of them.
LEAST = 1
#: Training tokens (for the vocabulary: distinct ones, at most) that a part of a level has about.
PART_TOKENS = 1 << 20
#: Tokens that a task counts before it sends a run.
RUN_TOKENS = 1 << 20
#: Bytes of text that are scored together: the more, the fewer lookups.
SCORE_BYTES = 4 << 20
#: Probabilities are kept as 16-bit codes of their logarithm from 10**-SPAN to 1.
SPAN = 10.0
#: Distinct tokens have to be fewer; longer n-grams may be more.
MOST = (1 << 32) - 1
END = np.uint64(0xE17A1465_5EED0E0D)


def quantise(p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(np.log10(np.maximum(p, 1e-300)) / SPAN + 1, 0, 1) * 65535).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return 10.0 ** ((code.astype(np.float64) / 65535 - 1) * SPAN)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each followed by an end, and n + 1 bounds."""
    data, offsets = bw.buffers(texts)
    h, _, bounds = bw.words(data, offsets, bw.BLANK_SEPARATED)
    n = len(bounds) - 1
    out = np.full(len(h) + n, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] + np.arange(n)] = False
    out[inside] = h
    return out, bounds + np.arange(n + 1)


@dataclass
class Level:
    """The index is a file with the parts' numbers, first hashes or contexts, the ranks of their first entries, and their entries."""

    folder: str
    index: str
    parts: int
    n: int

    def file(self, part: int) -> str:
        return f"{self.folder}-{part:08d}"


@dataclass
class Trie:
    """What a task needs to open the levels; the levels themselves stay in files."""

    total: int = 0
    distinct: int = 0
    levels: list[Level] = field(default_factory=list)


@dataclass
class Segment:
    file: dict
    first: int
    offset: int


class Levels:
    """The opened trie."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.files: dict[str, dict[str, np.ndarray]] = {}
        self.index = [map_arrays(local_path(level.index)) if level.parts else None for level in trie.levels]

    def _file(self, uri: str) -> dict[str, np.ndarray]:
        if uri not in self.files:
            arrays = map_arrays(local_path(uri))
            for name in ("pointers", "successors"):
                if f"{name}.size" in arrays:
                    arrays[name] = EliasFano.from_arrays(arrays, name)
            self.files[uri] = arrays
        return self.files[uri]

    def _parts(self, level: int, keys: np.ndarray) -> Iterator[tuple[slice, Segment]]:
        """The parts that sorted keys fall into."""
        index = self.index[level]
        if index is None or not len(keys):
            return
        at = np.maximum(np.searchsorted(index["firsts"], keys, "right") - 1, 0)
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            i = at[a]
            yield slice(a, b), Segment(self._file(self.trie.levels[level].file(int(index["parts"][i]))), int(index["firsts"][i]), int(index["offsets"][i]))

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for part, segment in self._parts(0, hashes):
            f = segment.file
            own, wanted = f["hashes"], hashes[part]
            at = np.searchsorted(own, wanted)
            at[at == len(own)] = 0
            known = own[at] == wanted if len(own) else np.zeros(len(wanted), bool)
            ids[part] = np.where(known, at + segment.offset, -1)
            counts[part] = np.where(known, f["counts"][at] if len(own) else 0, 0)
        return ids, counts

    def successors(self, level: int, contexts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For contexts (sorted; no negative ones) and ids: rank in the level (-1: not there), discounted probability, rest."""
        rank, p, rest = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.ones(len(ids))
        for part, segment in self._parts(level, contexts.astype(np.uint64)):
            f = segment.file
            local, word = contexts[part] - segment.first, ids[part]
            inside = local < len(f["rests"])
            context, back = np.unique(np.where(inside, local, 0), return_inverse=True)
            begin, end = f["pointers"].get(context).astype(np.int64), f["pointers"].get(context + 1).astype(np.int64)
            base = np.zeros(len(context), np.uint64)
            later = (begin > 0) & (begin < end)
            base[later] = f["successors"].get(begin[later] - 1) + np.uint64(1)
            rest[part] = np.where(inside, probability(f["rests"][context])[back], 1.0)
            look = np.flatnonzero(inside & (begin < end)[back])
            at, equal = f["successors"].successor(base[back[look]] + word[look].astype(np.uint64))
            found = equal & (at < end[back[look]])
            look, at = look[found], at[found]
            start = part.start
            rank[start + look] = at + segment.offset
            p[start + look] = probability(f["probabilities"][at])
        return rank, p, rest


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: the high bytes of small numbers are long runs then."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplanes(raw: bytes, at: int, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).reshape(n)


def _run(part: int, local: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """A sorted run of (context in the part or hash, id, count) as compressed bytes."""
    n = np.array([len(ids)], np.int64)
    step = np.diff(local.astype(np.uint64), prepend=np.zeros(1, np.uint64))
    return part, zstandard.ZstdCompressor(level=1).compress(b"".join([n.tobytes(), _planes(step), _planes(ids.astype(np.uint32)), _planes(counts.astype(np.uint32))]))


def _unrun(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.cumsum(_unplanes(raw, 8, n, np.uint64), dtype=np.uint64), _unplanes(raw, 8 + 8 * n, n, np.uint32), _unplanes(raw, 8 + 12 * n, n, np.uint32)


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of a part as one: distinct (context, id) in order, with summed counts."""
    runs = [_unrun(b) for b in blobs]
    local, ids, counts = (np.concatenate([r[i] for r in runs]) for i in range(3))
    order = np.lexsort((ids, local))
    local, ids, counts = local[order], ids[order], counts[order].astype(np.int64)
    new = np.ones(len(ids), bool)
    new[1:] = (local[1:] != local[:-1]) | (ids[1:] != ids[:-1])
    at = np.flatnonzero(new)
    return local[at], ids[at], np.add.reduceat(counts, at) if len(at) else counts


_RUNS = "part long, run binary"
_FILES = "part long, n long, tokens long, marks array<long>, weights array<long>"


def _marks(counts: np.ndarray, step: int) -> tuple[list[int], list[int]]:
    """Entries at which the summed counts pass a multiple of `step`, and the sums before them: where parts may be cut."""
    sums = np.cumsum(counts)
    at = np.flatnonzero(np.diff(sums // step, prepend=0)) if len(sums) else np.empty(0, np.int64)
    return (at + 1).tolist(), sums[at].tolist()


def _texts(documents: DataFrame, text: str) -> DataFrame:
    return documents.select(F.col(text).alias("text"))


def _build_words(texts: DataFrame, folder: str, bits: int, part_tokens: int) -> list[tuple]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen in _gathered(batches, lambda part: tokens(part.column(0))[0]):
            hashes, counts = np.unique(seen, return_counts=True)
            cuts = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.array([0])
            yield _runs_batch([_run(i, hashes[a:b], np.zeros(b - a), counts[a:b]) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(hashes)], strict=True)) if b > a])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        hashes, _, counts = _merged(table["run"].to_pylist())
        write_file(f"{folder}/words-{key[0].as_py():08d}", pack_arrays({"hashes": hashes, "counts": counts}))
        return _file_row(key[0].as_py(), len(hashes), counts, part_tokens)

    return sorted(map(tuple, _by_part(texts.mapInArrow(count, _RUNS), 1 << bits).applyInArrow(merge, _FILES).collect()))


def _by_part(runs: DataFrame, parts: int) -> GroupedData:
    """The runs by part, about two parts to a task, so that a task has as much to read at any size of input."""
    return runs.repartition(-(-parts // 2), "part").groupBy("part")


def _gathered(batches: Iterator[pa.RecordBatch], of: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[np.ndarray]:
    """Arrays from slices of the batches, joined up to about RUN_TOKENS rows."""
    held, n = [], 0
    for batch in batches:
        for part in bw.slices(batch, "text"):
            held.append(of(part))
            n += len(held[-1])
            if n >= RUN_TOKENS:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def _runs_batch(runs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.binary())], ["part", "run"])


def _file_row(part: int, n: int, counts: np.ndarray, part_tokens: int) -> pa.Table:
    marks, weights = _marks(counts, part_tokens)
    return pa.table({"part": [part], "n": [n], "tokens": [int(counts.sum())], "marks": pa.array([marks], pa.list_(pa.int64())), "weights": pa.array([weights], pa.list_(pa.int64()))})


def token_ids(levels: Levels, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and counts of the distinct tokens, and for all tokens their place among these; the id of an end."""
    distinct, back = np.unique(hashes, return_inverse=True)
    ids, counts = levels.words(distinct)
    return ids[back], counts[back], back, levels.words(np.array([END]))[0]


def contexts_of(levels: Levels, ids: np.ndarray, bounds: np.ndarray, end_id: int, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For levels 2 to `order`: each token's context at that level (-1: none), and what the level says of it: rank, p, rest.

    The first token of a text follows an end. What a missing level would say isn't asked: the last item has only contexts.
    """
    first = bounds[:-1]
    context = np.empty(len(ids), np.int64)
    context[1:] = ids[:-1]
    context[first] = end_id
    for level in range(1, order):
        if level >= len(levels.trie.levels):
            yield context, np.empty(0), np.empty(0), np.empty(0)
            return
        rank, p, rest = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.ones(len(ids))
        there = np.flatnonzero(context >= 0)
        # equal pairs are looked up once; unknown words have no id to look for, but their contexts still have a rest
        own, names = context[there], None
        if len(own) and own.max() >= MOST:  # too large to be packed with an id: their ranks are
            names, own = np.unique(own, return_inverse=True)
        distinct, back = np.unique((own.astype(np.uint64) << np.uint64(32)) + (ids[there] + 1).astype(np.uint64), return_inverse=True)
        word, own = (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1, (distinct >> np.uint64(32)).astype(np.int64)
        r, q, s = levels.successors(level, own if names is None else names[own], np.maximum(word, 0))
        r[word < 0], q[word < 0] = -1, 0
        rank[there], p[there], rest[there] = r[back], q[back], s[back]
        yield context, rank, p, rest
        following = np.full(len(ids), -1, np.int64)
        following[1:] = rank[:-1]
        following[first] = -1
        context = following


def _build_level(texts: DataFrame, trie: Trie, level: int, folder: str, starts: np.ndarray, weights: np.ndarray, part_tokens: int, last: bool) -> list[tuple]:
    spark = texts.sparkSession
    # a part that weighs more than others is merged in so many ranges of successors first; all ranges are numbered through
    ranges = np.where(weights > 2 * part_tokens, -(-weights // part_tokens), 1)
    begins = np.cumsum(ranges) - ranges
    sent = spark.sparkContext.broadcast((trie, starts, ranges, begins))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cuts, ranges, begins = sent.value
        levels = Levels(known)

        def pairs(part: pa.RecordBatch) -> np.ndarray:
            hashes, bounds = tokens(part.column(0))
            ids, counts, _, end = token_ids(levels, hashes)
            *_, (context, _, _, _) = contexts_of(levels, ids, bounds, int(end[0]), level + 1)
            often = (context >= 0) & (ids >= 0) & (counts >= LEAST)
            return np.stack([context[often], ids[often]], 1)

        for rows in _gathered(batches, pairs):
            part = np.searchsorted(cuts, rows[:, 0], "right") - 1
            slot = begins[part] + rows[:, 1] * ranges[part] // known.distinct
            order = np.argsort(slot, kind="stable")
            slot, part, rows = slot[order], part[order], rows[order]
            edges = np.flatnonzero(np.diff(slot, prepend=-1, append=begins[-1] + ranges[-1]))
            runs = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                packed, counts = np.unique(((rows[a:b, 0] - cuts[part[a]]).astype(np.uint64) << np.uint64(32)) | rows[a:b, 1].astype(np.uint64), return_counts=True)
                runs.append(_run(int(slot[a]), packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF), counts))
            yield _runs_batch(runs)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        known, cuts, ranges, begins = sent.value
        slot = key[0].as_py()
        part = int(np.searchsorted(begins, slot, "right")) - 1
        merged = _merged(table["run"].to_pylist())
        if ranges[part] == 1:
            return _finish(known, level, folder, part, cuts, merged, part_tokens, last)
        write_file(f"{folder}-run{slot:08d}", _run(slot, *merged)[1])
        return _file_row(-1 - slot, 0, merged[2][:0], part_tokens)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        known, cuts, _, _ = sent.value
        merged = _merged([read_file(f"{folder}-run{slot:08d}") for slot in table["slot"].to_pylist()])
        return _finish(known, level, folder, key[0].as_py(), cuts, merged, part_tokens, last)

    rows = _by_part(texts.mapInArrow(count, _RUNS), int(ranges.sum())).applyInArrow(merge, _FILES).collect()
    files = [tuple(r) for r in rows if r[0] >= 0]
    split = [(int(np.searchsorted(begins, -1 - r[0], "right")) - 1, -1 - r[0]) for r in rows if r[0] < 0]
    if split:
        files += map(tuple, _by_part(spark.createDataFrame(split, "part long, slot long"), 2 * len({p for p, _ in split})).applyInArrow(join, _FILES).collect())
        delete_files(spark, [f"{folder}-run{slot:08d}" for _, slot in split])
    return sorted(files)


def _finish(trie: Trie, level: int, folder: str, part: int, cuts: np.ndarray, merged: tuple, part_tokens: int, last: bool) -> pa.Table:
    """Writes one part of a level from its distinct (context, id) and their counts, which only a further level needs again."""
    first = int(cuts[part])
    end = int(cuts[part + 1]) if part + 1 < len(cuts) else trie.levels[level - 1].n
    local, ids, counts = merged
    often = counts >= LEAST
    local, ids, counts = local[often].astype(np.int64), ids[often], counts[often]
    p = (counts - DISCOUNT) / _counts(Levels(trie), level - 1, first, end)[local]
    rests = np.clip(1 - np.bincount(local, p, end - first), 0, 1)
    pointers = np.searchsorted(local, np.arange(end - first + 1))
    # each context's ids go on from the last number of the context before
    begins = np.unique(local, return_index=True)[1]
    ends = np.append(begins[1:], len(local))
    steps = np.zeros(len(local), np.uint64)
    if len(local):
        steps[begins[1:]] = ids[ends[:-1] - 1].astype(np.uint64) + np.uint64(1)
    numbers = np.cumsum(steps, dtype=np.uint64) + ids
    arrays = EliasFano.of(pointers.astype(np.uint64)).arrays("pointers") | EliasFano.of(numbers).arrays("successors")
    write_file(f"{folder}-{part:08d}", pack_arrays(arrays | {"probabilities": quantise(p), "rests": quantise(rests)} | ({} if last else {"counts": counts.astype(np.uint32)})))
    return _file_row(part, len(ids), counts, part_tokens)


def _counts(levels: Levels, level: int, first: int, last: int) -> np.ndarray:
    """The counts of entries first to last of a level."""
    index, parts = levels.index[level], []
    offsets, sizes = index["offsets"], index["sizes"]
    for i in range(max(int(np.searchsorted(offsets, first, "right")) - 1, 0), int(np.searchsorted(offsets, last))):
        a, b = max(first, int(offsets[i])), min(last, int(offsets[i] + sizes[i]))
        if a < b:
            own = map_arrays(local_path(levels.trie.levels[level].file(int(index["parts"][i]))))["counts"]
            parts.append(own[a - int(offsets[i]) : b - int(offsets[i])].astype(np.int64))
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _cuts(files: list[tuple], part_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Where to cut a level's entries so that the parts have about equal counts, and the parts' counts.

    An entry with more is a part's last.
    """
    out, weights, offset, carried = [0], [], 0, 0
    for _, n, total, marks, sums in files:
        for mark, weight, before in zip(marks, sums, [0, *sums], strict=False):
            carried += weight - before
            if carried >= part_tokens and offset + mark > out[-1]:
                out.append(offset + mark)
                weights.append(carried)
                carried = 0
        carried += total - (sums[-1] if sums else 0)
        offset += n
    weights.append(carried)
    if out[-1] >= offset and len(out) > 1:  # nothing is left behind the last cut
        out.pop()
        weights.pop()
    return np.array(out, np.int64), np.array(weights, np.int64)


def _level(folder: str, name: str, files: list[tuple], firsts: list[int]) -> Level:
    """Writes the index of a level's files."""
    sizes = np.array([f[1] for f in files], np.int64)
    arrays = {"parts": np.array([f[0] for f in files], np.int64), "firsts": np.array(firsts, np.uint64), "offsets": np.cumsum(sizes) - sizes, "sizes": sizes}
    if files:
        write_file(f"{folder}/{name}-index", pack_arrays(arrays))
    return Level(f"{folder}/{name}", f"{folder}/{name}-index", len(files), int(sizes.sum()))


def train(documents: DataFrame, *, text: str = "text", order: int = 3, part_tokens: int = PART_TOKENS) -> Trie:
    """A trie up to n-grams of `order` tokens over all whole texts of these documents, null texts as empty ones.

    Its files are in the shared folder. No documents give a trie without tokens, under which every text is a sequence of unknown ones.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    folder = new_folder(spark, "trie")
    texts = _texts(documents, text)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, (size // (8 * part_tokens)).bit_length())
    trie = Trie()
    files = _build_words(texts, folder, bits, part_tokens)
    trie.total, trie.distinct = sum(f[2] for f in files), sum(f[1] for f in files)
    if trie.distinct >= MOST:
        raise ValueError(f"{trie.distinct} distinct tokens don't fit ids of 32 bits")
    trie.levels.append(_level(folder, "words", files, [f[0] << (64 - bits) if bits else 0 for f in files]))
    for k in range(1, order):
        if not trie.levels[-1].n:
            break
        starts, weights = _cuts(files, part_tokens)
        files = _build_level(texts, trie, k, f"{folder}/level{k + 1}", starts, weights, part_tokens, k + 1 == order)
        trie.levels.append(_level(folder, f"level{k + 1}", files, [int(starts[f[0]]) for f in files]))
    return trie


FOUND = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def score_texts(levels: Levels, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: tokens with the end, known ones, log10 probability by add-one counts, and by the trie."""
    n, v = levels.trie.total, levels.trie.distinct
    hashes, bounds = tokens(texts)
    ids, counts, _, end = token_ids(levels, hashes)
    at = bounds[:-1]
    base = np.log10((counts + 1) / (n + v + 1))
    p = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * v / (v + 1)) / n if n else np.ones(len(ids))
    for context, _, q, rest in contexts_of(levels, ids, bounds, int(end[0]), len(levels.trie.levels)):
        p = np.where(context >= 0, q + rest * p, p)
    return np.diff(bounds), np.add.reduceat(counts > 0, at, dtype=np.int64), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)


def score(documents: DataFrame, trie: Trie, *, text: str = "text") -> DataFrame:
    """The documents, row by row, with `lm`: struct of n_tokens, n_known, base_score and score (log10 probabilities of whole texts).

    A null text counts as empty: one end. Repeated rows get the same scores; very long texts are read whole. Other columns stay; one
    named `lm` is replaced. An empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(trie)

    def make() -> Callable[[pa.Array], pa.Array]:
        levels = Levels(sent.value)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return lambda texts: pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(score_texts(levels, texts), kinds, strict=True)], [f.name for f in FOUND.fields])

    return with_text_column(documents, "lm", FOUND, text, make, most=SCORE_BYTES)


def learnable(doc_id: Column, modulus: int = 7) -> Column:
    """Rows that models may learn from: crc32 of the id as text leaves another remainder than 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus != 2, F.lit(True))

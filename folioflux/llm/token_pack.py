"""Token ids as packed binary matrices: best-fit-decreasing packing with a segment tree over capacities.

Each task reads its documents in chunks of bounded tokens, cuts documents that are longer than a row without loss, and places the
pieces of a chunk, largest first, each in the open row with the least room that is enough; a segment tree over the possible rooms
finds it in log(capacity) steps. Rows that are full go out; open rows wait for the next chunk, and the fullest of them go out when
too many wait. Nothing is shuffled, and memory is bounded by the chunk and the open rows, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflux.llm import bytewords as bw
from folioflux.llm.shared import bound_batches, write_file
from folioflux.llm.tokenizing import ids_of

#: Tokens that are packed at once, and rows that may wait open.
CHUNK_TOKENS = 2 << 20
OPEN_ROWS = 512

SCHEMA = "sequence_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"


class CapacityTree:
    """Open rows by room. Each inner node holds the largest room that occurs below it; `take` descends to the least that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.most = [-1] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _set(self, room: int, value: int) -> None:
        i = self.leaves + room
        self.most[i] = value
        while i > 1:
            i >>= 1
            value = max(self.most[2 * i], self.most[2 * i + 1])
            if self.most[i] == value:
                break
            self.most[i] = value

    def put(self, room: int, row: int) -> None:
        here = self.rows.setdefault(room, [])
        here.append(row)
        if len(here) == 1:
            self._set(room, room)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least `need`, out of the tree; None if there is none."""
        if self.most[1] < need:
            return None
        i, low, width = 1, 0, self.leaves
        while i < self.leaves:
            width >>= 1
            # rooms in the left half are all less than those in the right
            if self.most[2 * i] >= need:
                i = 2 * i
            else:
                i, low = 2 * i + 1, low + width
        row = self.rows[low].pop()
        if not self.rows[low]:
            self._set(low, -1)
        return low, row


class Packer:
    """Rows of one task: lists of (doc_id, piece, start, ids)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.tree = CapacityTree(capacity)
        self.open: dict[int, list] = {}
        self.next = 0

    def add(self, pieces: list[tuple]) -> list[list[tuple]]:
        """Places a chunk's pieces, largest first; gives the rows that are full, and the fullest of too many open ones."""
        done = []
        for piece in sorted(pieces, key=lambda p: -len(p[3])):
            size = len(piece[3])
            found = self.tree.take(size)
            if found is None:
                room, row = self.capacity, self.next
                self.open[row], self.next = [], self.next + 1
            else:
                room, row = found
            self.open[row].append(piece)
            if room == size:
                done.append(self.open.pop(row))
            else:
                self.tree.put(room - size, row)
        for room in sorted(self.tree.rows):
            while len(self.open) > OPEN_ROWS and self.tree.rows[room]:
                _, row = self.tree.take(room)
                done.append(self.open.pop(row))
        return done

    def rest(self) -> list[list[tuple]]:
        out, self.open, self.tree = list(self.open.values()), {}, CapacityTree(self.capacity)
        return out


def _batch(rows: list[list[tuple]], first: int, capacity: int, pad_id: int, kind: np.dtype) -> pa.RecordBatch:
    ids, positions, lengths = [], [], []
    for row in rows:
        sizes = [len(p[3]) for p in row]
        used = sum(sizes)
        ids.append(np.concatenate([*[p[3] for p in row], np.full(capacity - used, pad_id, np.uint32)]).astype(kind).tobytes())
        positions.append(np.concatenate([*map(np.arange, sizes), np.zeros(capacity - used, np.int64)]).astype("<u4").tobytes())
        lengths.append(np.cumsum([0, *sizes]).tolist())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(first, first + len(rows)), pa.int64()), pa.array([x[-1] for x in lengths], pa.int32()), pa.array(ids, pa.binary()), pa.array(positions, pa.binary()), pa.array(lengths, pa.list_(pa.int32())),
            pa.array([[p[0] for p in row] for row in rows], pa.list_(pa.int64())), pa.array([[p[1] for p in row] for row in rows], pa.list_(pa.int32())), pa.array([[p[2] for p in row] for row in rows], pa.list_(pa.int64())),
        ],
        ["sequence_id", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "pieces", "starts"],
    )


def pack_tokens(documents: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 50256, pad_id: int = 50256, doc_id: str = "doc_id", text: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """All documents, each ended by `end_id`, as rows of a packed matrix of ids, `capacity` wide.

    Columns: sequence_id (unique), n_tokens (without padding), ids (binary; little-endian, unsigned 16-bit if all ids of the tokenizer
    fit, else 32-bit; padded), positions (binary, unsigned 32-bit; from 0 in each segment, 0 in the padding), cu_seqlens (0 and the
    cumulative lengths of the segments), doc_ids, pieces and starts (of each segment: whose it is, which piece, tokens before it).
    A document of more than `capacity` tokens is cut into full pieces and a last one, without loss. A null or empty text is the end id
    alone; a null id stays null. Repeated rows are packed each. An empty table gives no rows. Other columns take no part.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, pieces, tokens = ids_of(tokenizer_path), Packer(capacity), [], 0
        kind = np.dtype("<u2" if max(coder.size - 1, end_id, pad_id) < 1 << 16 else "<u4")
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def out(rows: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for i in range(0, len(rows), 256):
                yield _batch(rows[i : i + 256], number, capacity, pad_id, kind)
                number += len(rows[i : i + 256])

        for batch in batches:
            for part in bw.slices(batch, "text"):
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(coder.encode(t or ""), np.uint32(end_id)).astype(np.uint32)
                    pieces += [(name, k, s, ids[s : s + capacity]) for k, s in enumerate(range(0, len(ids), capacity))]
                    tokens += len(ids)
                    if tokens >= chunk_tokens:
                        yield from out(packer.add(pieces))
                        pieces, tokens = [], 0
        yield from out(packer.add(pieces))
        yield from out(packer.rest())

    bound_batches(documents.sparkSession)
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, SCHEMA)


def write_matrices(packed: DataFrame, uri: str) -> DataFrame:
    """Writes the rows as binary files under a shared folder and gives a row for each file set: name, n_rows, n_segments.

    NAME.ids and NAME.positions hold the matrices row by row; NAME.cu_seqlens the rows' cumulative lengths (little-endian unsigned
    32-bit) one after another; NAME.index the first place in it of each row and its end (unsigned 64-bit). The name is made of the
    rows' own ids, so a repeated task writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            name = f"rows-{batch.column('sequence_id')[0].as_py():016x}"
            lengths = batch.column("cu_seqlens").to_pylist()
            write_file(f"{uri}/{name}.ids", b"".join(batch.column("ids").to_pylist()))
            write_file(f"{uri}/{name}.positions", b"".join(batch.column("positions").to_pylist()))
            write_file(f"{uri}/{name}.cu_seqlens", np.concatenate([np.array(x, "<u4") for x in lengths]).tobytes())
            write_file(f"{uri}/{name}.index", np.cumsum([0, *map(len, lengths)]).astype("<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"name": [name], "n_rows": [batch.num_rows], "n_segments": [sum(len(x) - 1 for x in lengths)]})

    return packed.select("sequence_id", "ids", "positions", "cu_seqlens").mapInArrow(write, "name string, n_rows long, n_segments long")

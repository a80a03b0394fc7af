"""Token ids packed into fixed-length sequences and written as binary matrices.

Documents are encoded with a public byte-level vocabulary (its file is a
parameter, read by the driver and sent to the tasks) and end with one
end-of-text id.  Documents longer than a sequence are cut into full pieces and a
rest, without loss.  A task collects pieces up to ``POOL_TOKENS`` and packs each
pool with best-fit decreasing: pieces by falling length, each into the sequence
with the least room that still fits, found with a segment tree over the rooms.
There is no shuffle; a pool bounds the memory of a task, and only the last few
sequences of a pool stay partly empty.

Output, one row per matrix of up to ``ROWS`` sequences:

* ``ids``: n_rows x seq_len ids, row-major, little-endian (``dtype``), padded
  with the end-of-text id;
* ``cu_seqlens``: per sequence the cumulative segment lengths, from 0;
* ``resets``: per sequence the places where position ids start again at 0 (every
  segment, and the padding if there is any);
* ``doc_ids``, ``offsets``, ``totals``: per segment its document, the token
  offset of the piece in the document, and the document's number of tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_rows
from tessera.llm.grams import releasing

VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
SEQ_LEN = 2048
ROWS = 64
POOL_TOKENS = 4_000_000
CHUNK_CHARS = 100_000  # longer texts are encoded in chunks, cut where the pattern breaks anyway
# Before a single space between two letters: no match of the pattern goes past it.
BREAK = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")

SCHEMA = ("matrix bigint, n_rows int, seq_len int, dtype string, ids binary, cu_seqlens array<array<int>>, "
          "resets array<array<int>>, doc_ids array<array<bigint>>, offsets array<array<int>>, totals array<array<int>>")


def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_vocabulary(path: str = VOCABULARY_FILE) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def chunks(text: str) -> Iterator[str]:
    """Parts of a text whose ids, one after another, are those of the whole text; a run without a break stays whole."""
    start = 0
    while len(text) - start > CHUNK_CHARS and (cut := BREAK.search(text, start + CHUNK_CHARS)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


class Rooms:
    """Segment tree over rooms 0..size: the smallest room >= n that some open sequence has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._add(room, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """(sequence, its room) with the least room >= n; None if there is none."""
        i = n + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        sequence = self.open[room].pop()
        self._add(room, -1)
        return sequence, room


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Indexes of the pieces in each sequence, by best-fit decreasing."""
    rooms, sequences = Rooms(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        found = rooms.take(n) if n < size else None
        if found is None:
            sequences.append([i])
            rooms.put(size - n, len(sequences) - 1)
        else:
            sequences[found[0]].append(i)
            rooms.put(found[1] - n, found[0])
    return sequences


def _matrices(pool: list[tuple], size: int, rows: int, kind: str, pad: int):
    """``pool``: (doc_id, offset, total, ids) pieces of at most ``size`` ids."""
    sequences = best_fit([len(p[3]) for p in pool], size)
    for at in range(0, len(sequences), rows):
        block = sequences[at:at + rows]
        ids = np.full((len(block), size), pad, dtype=kind)
        cu, resets, docs, offsets, totals = [], [], [], [], []
        for r, sequence in enumerate(block):
            ends = [0]
            for i in sequence:
                piece = pool[i][3]
                ids[r, ends[-1]:ends[-1] + len(piece)] = piece
                ends.append(ends[-1] + len(piece))
            cu.append(ends)
            resets.append(ends if ends[-1] < size else ends[:-1])
            docs.append([pool[i][0] for i in sequence])
            offsets.append([pool[i][1] for i in sequence])
            totals.append([pool[i][2] for i in sequence])
        yield len(block), ids.tobytes(), cu, resets, docs, offsets, totals


def _pack(vocabulary: bytes, size: int, rows: int, pool_tokens: int, eot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        kind = "<u2" if max(eot, enc.max_token_value) < 1 << 16 else "<u4"
        made = TaskContext.get().partitionId() << 32
        ints, lists = pa.int32(), lambda t: pa.list_(pa.list_(t))

        def rows_of(pool):
            nonlocal made
            for n, ids, cu, resets, docs, offsets, totals in _matrices(pool, size, rows, kind, eot):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([made], pa.int64()), pa.array([n], ints), pa.array([size], ints), pa.array([kind]),
                     pa.array([ids], pa.binary()), pa.array([cu], lists(ints)), pa.array([resets], lists(ints)),
                     pa.array([docs], lists(pa.int64())), pa.array([offsets], lists(ints)), pa.array([totals], lists(ints))],
                    names=["matrix", "n_rows", "seq_len", "dtype", "ids", "cu_seqlens", "resets", "doc_ids", "offsets",
                           "totals"])
                made += 1

        pool, held = [], 0
        for rb in batches:
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                parts = [enc.encode_to_numpy(c, disallowed_special=()) for c in chunks(text or "")]
                ids = np.concatenate([*parts, [eot]]).astype(kind)
                for offset in range(0, len(ids), size):
                    pool.append((doc_id, offset, len(ids), ids[offset:offset + size]))
                held += len(ids)
                if held >= pool_tokens:
                    yield from rows_of(pool)
                    pool, held = [], 0
        if pool:
            yield from rows_of(pool)
    return run


def packed(docs: DataFrame, vocabulary_file: str = VOCABULARY_FILE, seq_len: int = SEQ_LEN, rows: int = ROWS,
           pool_tokens: int = POOL_TOKENS, end_of_text: int = END_OF_TEXT) -> DataFrame:
    """Packed matrices of all documents (see the module's text for the columns).

    Defined cases: null and empty texts are one end-of-text id; a null id is
    null in ``doc_ids``; repeated rows are packed each; a document of any length
    is cut into pieces; empty tables give no matrices; other columns are not read.
    """
    pack = _pack(read_vocabulary(vocabulary_file), seq_len, rows, pool_tokens, end_of_text)
    return text_rows(docs, F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(releasing(pack), SCHEMA)


def position_ids(cu_seqlens: list[int], seq_len: int) -> np.ndarray:
    """Position ids of one sequence: 0, 1, ... from each reset."""
    starts = [*cu_seqlens[:-1], *([cu_seqlens[-1]] if cu_seqlens[-1] < seq_len else [])]
    lengths = np.diff([*starts, seq_len])
    return np.arange(seq_len) - np.repeat(starts, lengths)


def segments(row) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """(doc_id, offset, total, ids) of every segment of one output row."""
    ids = np.frombuffer(row["ids"], dtype=row["dtype"]).reshape(row["n_rows"], row["seq_len"])
    for r in range(row["n_rows"]):
        cu = row["cu_seqlens"][r]
        for k, doc_id in enumerate(row["doc_ids"][r]):
            yield doc_id, row["offsets"][r][k], row["totals"][r][k], ids[r, cu[k]:cu[k + 1]]

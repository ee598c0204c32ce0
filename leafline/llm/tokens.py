"""Token ids in packed sequences of one length, by best-fit decreasing.

Texts are encoded where they are read; nothing is shuffled. A task gathers pieces up
to a bounded number of tokens and packs them: longest first, each into the open sequence with the
least room that still takes it. A segment tree over the possible rooms finds that sequence in
logarithmic time. A document longer than a sequence is split into pieces that together
are exactly its ids. Only the last sequences of a task's blocks are left less than full.

A row of the result is one sequence: a row of the id matrix, the cumulative segment lengths,
the places where positions begin again at 0, and for each segment its document, the
number of the piece and the piece's first token in the document.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import table

#: A rank file of byte-level BPE on every machine; the id after its last rank ends a document.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END_ID = 50256
#: How the vocabulary's authors split text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
#: Tokens packed together, which bounds a task's memory (two bytes each).
BLOCK_TOKENS = 4_000_000
#: Characters encoded at a time.
PIECE = 1 << 20
ROWS = 256

SCHEMA = (
    "task int, row long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, pieces array<int>, piece_starts array<long>"
)
ARROW = pa.schema(
    [
        ("task", pa.int32()),
        ("row", pa.int64()),
        ("n_tokens", pa.int32()),
        ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_resets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("pieces", pa.list_(pa.int32())),
        ("piece_starts", pa.list_(pa.int64())),
    ]
)
_CUT = re.compile(r"\S(?= \S)")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = TOKENIZER) -> np.ndarray:
    """The ids of the whole text and END_ID after them, as uint16.

    A long text is encoded in parts that end before a single space after a word, where
    no token of this pattern goes across.
    """
    own, out, at, text = encoding(path), [], 0, text or ""
    while at < len(text):
        cut = _CUT.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.end() if cut else len(text)
        out.append(np.array(own.encode_ordinary(text[at:end]), dtype=np.uint16))
        at = end
    out.append(np.array([END_ID], dtype=np.uint16))
    return np.concatenate(out)


class Rooms:
    """Open sequences by the room left in them, with a segment tree over rooms that are not empty."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.open: list[list[int]] = [[] for _ in range(length + 1)]
        self.any = [0] * (2 * self.leaves)

    def _mark(self, room: int, there: int) -> None:
        i = self.leaves + room
        while i and self.any[i] != there:
            self.any[i] = there
            i //= 2
            there = self.any[2 * i] | self.any[2 * i + 1] if i else 0

    def put(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._mark(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(sequence, room) with the least room of at least ``need``, taken out; None if there is none."""
        i = self.leaves + need
        if not self.any[i]:
            while i > 1 and (i % 2 or not self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            self._mark(room, 0)
        return sequence, room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """The pieces of each sequence; sizes are 1 to length, ties go by the pieces' order."""
    rooms, sequences = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        if found is None:
            found = len(sequences), length
            sequences.append([])
        sequences[found[0]].append(i)
        rooms.put(found[1] - sizes[i], found[0])
    return sequences


def _packed(pieces: list[tuple], length: int, task: int, row: int) -> Iterator[pa.RecordBatch]:
    """Batches of ARROW rows for pieces (doc_id, number, start, ids)."""
    pieces.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1], p[2]))
    sequences = best_fit_decreasing([len(p[3]) for p in pieces], length)
    for at in range(0, len(sequences), ROWS):
        columns: list[list] = [[] for _ in ARROW.names]
        for k, members in enumerate(sequences[at : at + ROWS], at):
            own = [pieces[i] for i in members]
            ends = np.cumsum([len(p[3]) for p in own])
            ids = np.full(length, END_ID, dtype="<u2")
            ids[: ends[-1]] = np.concatenate([p[3] for p in own])
            cu = [0, *ends.tolist()]
            values = (task, row + k, cu[-1], ids.tobytes(), cu, cu[:-1], [p[0] for p in own], [p[1] for p in own], [p[2] for p in own])
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)


def pack(
    docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Packed sequences of all rows of docs: SCHEMA.

    ids are ``length`` little-endian uint16, filled up with END_ID after n_tokens.
    cu_seqlens has one more entry than there are segments, and position_resets are the
    segments' first places. Null and empty texts are one END_ID, so every row of docs has a
    segment; repeated rows have one each; a null doc_id stays null; only doc_id and text are
    looked at; an empty table has no sequences. task and row name a sequence; they follow
    from how the input is cut into partitions, and agree between runs that read the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, held, pieces = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                ids, doc_id = encode(text.as_py(), tokenizer), doc_id.as_py()
                for number, start in enumerate(range(0, len(ids), length)):
                    pieces.append((doc_id, number, start, ids[start : start + length]))
                held += len(ids)
                if held >= block_tokens:
                    done = 0
                    for out in _packed(pieces, length, task, row):
                        done += out.num_rows
                        yield out
                    row, held, pieces = row + done, 0, []
        if pieces:
            yield from _packed(pieces, length, task, row)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def id_matrix(rows: list, length: int = LENGTH) -> np.ndarray:
    """The id matrix of collected or read rows of the result."""
    return np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), dtype="<u2").reshape(-1, length)


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes the sequences as Parquet files, each an id matrix with its segments.

    Rows are written as pack made them, repeated ones too; a table without rows gives files without rows. A path that is there is an error.
    """
    packed.write.parquet(path)


def op3_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

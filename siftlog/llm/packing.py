"""Operator 7: harmonic packing of documents into sequences of a fixed capacity.

Every document's ids (with an end id) are cut into whole sequences, then into powers of two
from the largest that fits down to ``TAIL``; what is left stays on the last piece. Lengths
fall into reciprocal classes: class k holds those in (capacity / (k + 1), capacity / k], and
each of its bins takes k pieces. Powers of two fill their bins to the last place, and the
rest are so short that their classes hold a single length or two.

Each worker fills its own bins, so nothing is shuffled and nothing waits for another
worker. What its bins still hold at its end, under k pieces a class, is closed as powers
of two where the pieces allow it and is packed first-fit by falling length otherwise.

Defined cases: a null or empty text is its end id alone; a null id and repeated rows are
packed like any other row; texts of any length are cut; an empty table gives no row; of
the other columns only doc_id is kept.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import vocabulary_path
from .common import bound_batches, remote, texts_of

CAPACITY = 1024
END = 0
#: Pieces are not cut below this; a document's last piece is under twice as long.
TAIL = 32
VOCABULARY = "byte_bpe_50k"
MEMO = 500_000
#: Sequences a worker may number.
PER_TASK = 1 << 40

_SPECIAL = "<|endoftext|>"
#: The fast splitter goes one level deeper with each blank of a run and would break on long ones.
LONG_RUN = 10_000
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d}" % LONG_RUN)


class ByteCodec(dict):
    """chunk -> ids as bytes. A chunk is a stretch without a blank, and the blank before it:
    the splitter starts a new piece there, whatever stands on either side."""

    def __init__(self, folder: str | None) -> None:
        import public_tokenizers
        import tiktoken

        super().__init__()
        self.json = vocabulary_path(VOCABULARY + ".json", folder)
        with open(vocabulary_path(VOCABULARY + ".tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._library = None

    def __missing__(self, chunk: str) -> bytes:
        out = np.array(self.coder.encode_ordinary(" " + chunk), "<u4").tobytes()
        if len(self) >= MEMO:
            self.clear()
        self[chunk] = out
        return out

    def library(self, text: str) -> bytes:
        """The slow way, for texts that hold a special string or a long run of white space."""
        from tokenizers import Tokenizer

        if self._library is None:
            self._library = Tokenizer.from_file(self.json)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if _SPECIAL in text or len(text) > LONG_RUN and _LONG_RUN.search(text):
            return self.library(text)
        first, *rest = text.split(" ")
        if rest and "" in rest[:-1]:  # a run of blanks is one piece with what precedes it
            return np.array(self.coder.encode_ordinary(text), "<u4").tobytes()
        head = np.array(self.coder.encode_ordinary(first), "<u4").tobytes()
        return head + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def codec(folder: str | None) -> ByteCodec:
    return ByteCodec(folder)


def cuts(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """Lengths of the pieces of ``n`` ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    if not rest:
        return out
    size = 1 << (capacity.bit_length() - 1)
    while rest:
        if rest < 2 * tail:
            return [*out, rest]
        while size > rest:
            size >>= 1
        out.append(size)
        rest -= size
    return out


def power(n: int) -> bool:
    return n & (n - 1) == 0


class Bins:
    """Open bins of one worker: class -> (sequence, tokens, pieces left)."""

    def __init__(self, base: int, capacity: int) -> None:
        self.next, self.capacity, self.open = base, capacity, {}

    def place(self, length: int) -> tuple[int, int]:
        k = self.capacity // length
        sequence, offset, left = self.open.get(k) or (self.fresh(), 0, k)
        if left > 1:
            self.open[k] = (sequence, offset + length, left - 1)
        else:
            self.open.pop(k, None)
        return sequence, offset

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1


def close(pieces: list[list], bins: Bins) -> None:
    """Places what the open bins held: [.., length, sequence, offset] lists, changed in place."""
    capacity = bins.capacity
    runs: dict[int, list[list]] = defaultdict(list)
    rest: list[list] = []
    for p in pieces:
        (runs[p[2]] if power(p[2]) else rest).append(p)
    for length, run in runs.items():
        while run:  # a run of 2^i equal powers of two is a power of two
            take = 1 << (min(len(run), capacity // length).bit_length() - 1)
            sequence = bins.fresh()
            for i in range(take):
                p = run.pop()
                p[-2:] = [sequence, i * length]
    shelves: list[list[int]] = []  # sequence, tokens
    for p in sorted(rest, key=lambda p: -p[2]):
        shelf = next((s for s in shelves if s[1] + p[2] <= capacity), None)
        if shelf is None:
            shelf = [bins.fresh(), 0]
            shelves.append(shelf)
        p[-2:] = shelf
        shelf[1] += p[2]


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def pack_batches(batches, capacity: int, tail: int, end: int, folder: str | None, ids: bool):
    from pyspark import TaskContext

    known, stop = codec(folder), np.array([end], "<u4").tobytes()
    bins = Bins(TaskContext.get().partitionId() * PER_TASK, capacity)
    held: dict[int, list[list]] = {}  # rows of open bins, not yet given out
    kind = pa.binary() if ids else pa.int64()
    content = (lambda raw: raw) if ids else zlib.crc32

    def table(rows: list, doc_type) -> pa.RecordBatch:
        doc, start, length, body, total, sequence, offset = zip(*rows) if rows else [()] * 7
        kinds = [doc_type, pa.int64(), pa.int64(), kind, pa.int64(), pa.int64(), pa.int64()]
        names = NAMES if ids else [x if x != "ids" else "ids_crc32" for x in NAMES]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((doc, start, length, body, total, sequence, offset), kinds)], names)

    doc_type = pa.int64()
    for batch in batches:
        out: list = []
        doc_type = batch.column("doc_id").type
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
            raw = known.encode(text) + stop
            n, start = len(raw) // 4, 0
            for length in cuts(n, capacity, tail):
                sequence, offset = bins.place(length)
                row = [doc, start, length, content(raw[4 * start : 4 * (start + length)]), n, sequence, offset]
                k = capacity // length
                waiting = held.setdefault(k, [])
                waiting.append(row)
                if k not in bins.open:  # the bin is full
                    out += waiting
                    waiting.clear()
                start += length
        yield table(out, doc_type)
    left = [row for rows in held.values() for row in rows]
    close(left, bins)
    yield table(left, doc_type)


def pack(docs: DataFrame, capacity: int = CAPACITY, tail: int = TAIL, end: int = END, folder: str | None = None, ids: bool = True) -> DataFrame:
    """Packed pieces of ``docs``: doc_id, start, length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset. One pass over the texts, no shuffle.

    ``ids=False`` gives ids_crc32 in place of the ids and spares their way to the JVM.
    """
    bound_batches(docs.sparkSession)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, start long, length long, {'ids binary' if ids else 'ids_crc32 long'}, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(remote(__name__, "pack_batches", capacity=capacity, tail=tail, end=end, folder=folder, ids=ids), schema)

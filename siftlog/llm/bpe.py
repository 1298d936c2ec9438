"""Operator 1: byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

Leaf i of the tree holds the rank of the pair that starts at symbol i, joined with i into
one integer, so that the root is the leftmost pair of lowest rank. A merge changes three
leaves, each in logarithmic time, until the root says that no pair can be merged.

Defined cases: a null or blank text has no ids and decodes to the empty string; the
vocabulary's special strings in a text become their ids; words of any length are merged
whole; rows repeat as they come, and null ids like others; an empty table gives no row; extra columns
are not touched by ``encode`` and ``decode``, whatever their names, if ``out`` is a new one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, remote, texts_of

VOCABULARY = "word_bpe_49k.json"
NONE = 1 << 62
#: Entries of a worker's memory of chunks; when full it starts anew.
MEMO = 600_000
#: Leaves of the trees that are merged at once.
FOREST = 1 << 19

#: What the vocabulary's splitter takes as white space.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Code points that are letters in one version of Unicode and not in another (and the rare planes whole):
#: chunks with them are left to the library, whose version counts.
_DRIFT = re.compile(
    "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u1c89\u208f\u209d-\u209f\ua7cb-\ua7f1\uab6c\uab6d\u1df6-\u1dff\U00010780-\U0001efff\U0002b73a-\U0010ffff]"
)
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed one."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in keep:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges ids by rank, lowest and then leftmost first. ranks: pair -> (rank, new id)."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    if n == 2:
        found = get((symbols[0], symbols[1]))
        return [found[1]] if found else symbols
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NONE] * (2 * size)
    symbols = list(symbols)
    for i in range(n - 1):
        found = get((symbols[i], symbols[i + 1]))
        if found:
            tree[size + i] = found[0] * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] != NONE:
        i = tree[1] % size
        j = after[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = get((symbols[i], symbols[k]))
            put(i, found[0] * size + i if found else NONE)
        else:
            put(i, NONE)
        if j < n - 1:
            put(j, NONE)
        p = before[i]
        if p >= 0:
            found = get((symbols[p], symbols[i]))
            put(p, found[0] * size + p if found else NONE)
    return [s for s in symbols if s >= 0]


class PairTable:
    """Ranks of pairs for whole arrays: one multiplicative hash; pairs that share a slot by bisection."""

    BITS = 20

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]) -> None:
        codes = np.array([(a << 20) | b for a, b in ranks], np.int64)
        order = np.argsort(codes)
        self.codes = np.append(codes[order], np.int64(NONE))
        self.rank = np.append(np.array([r for r, _ in ranks.values()], np.int64)[order], 0)
        self.made = np.zeros(len(ranks), np.int64)
        for rank, new in ranks.values():
            self.made[rank] = new
        slots = self._slot(self.codes[:-1])
        self.at = np.full(1 << self.BITS, len(ranks), np.int32)
        self.at[slots] = np.arange(len(ranks))
        self.shared = np.zeros(1 << self.BITS, bool)
        self.shared[np.flatnonzero(np.bincount(slots, minlength=1 << self.BITS) > 1)] = True

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        code = (a << 20) | b
        slot = self._slot(code)
        k = self.at[slot]
        hit = self.codes[k] == code
        again = self.shared[slot] & ~hit
        if again.any():
            k[again] = np.searchsorted(self.codes, code[again])
            hit = self.codes[k] == code
        return np.where(hit, self.rank[k] * size + at, NONE)


def merge_forest(words: np.ndarray, lengths: np.ndarray, table: PairTable) -> np.ndarray:
    """``merge_symbols`` for many words at once: one segment tree a row, all of one size.

    words: (m, size + 1) ids, ``size`` a power of two, padded beyond each length. Returns
    them merged in place, with -1 where a symbol went into its left neighbour.
    """
    m, width = words.shape
    size = width - 1
    shift = size.bit_length() - 1
    place = np.arange(size)
    tree = np.full((m, 2 * size), NONE, np.int64)
    leaf = table.leaves(words[:, :-1], words[:, 1:], place[None, :], size)
    leaf[place[None, :] >= (lengths - 1)[:, None]] = NONE
    tree[:, size:] = leaf
    k = size // 2
    while k:
        np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2], out=tree[:, k : 2 * k])
        k //= 2
    # flat views: a row's symbols start at row * width, its nodes at row * 2 * size
    symbols, nodes = words.reshape(-1), tree.reshape(-1)
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), m)
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), m)
    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        s, t = rows * width, rows * (2 * size)
        root = nodes[t + 1]
        i = root & (size - 1)
        j = after[s + i].astype(np.int64)
        new = table.made[root >> shift]
        k = after[s + j].astype(np.int64)
        symbols[s + i] = new
        symbols[s + j] = -1
        after[s + i] = k
        more = np.flatnonzero(k < lengths[rows])
        sm, km, im = s[more], k[more], i[more]
        before[sm + km] = im
        nodes[t + size + i] = NONE
        nodes[t[more] + size + im] = table.leaves(new[more], symbols[sm + km], im, size)
        held = np.flatnonzero(j < size)
        nodes[t[held] + size + j[held]] = NONE
        p = before[s + i].astype(np.int64)
        left = np.flatnonzero(p >= 0)
        pl = p[left]
        nodes[t[left] + size + pl] = table.leaves(symbols[s[left] + pl], new[left], pl, size)
        base = np.concatenate([t, t[held], t[left]])
        node = np.concatenate([size + i, size + j[held], size + pl]) >> 1
        for _ in range(shift):
            kids = base + 2 * node
            nodes[base + node] = np.minimum(nodes[kids], nodes[kids + 1])
            node >>= 1
        rows = rows[nodes[t + 1] != NONE]
    return words


class Codec:
    """The vocabulary of word pieces: normaliser, splitter, merges and decoder."""

    def __init__(self, path: str) -> None:
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        table = byte_alphabet()
        self.inner = [vocab.get(c) for c in table]
        self.last = [vocab.get(c + self.end) for c in table]
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.table = PairTable(self.ranks)
        self._inner = np.array([-1 if x is None else x for x in self.inner], np.int64)
        self._last = np.array([-1 if x is None else x for x in self.last], np.int64)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        inner, last = self.inner, self.last
        symbols = [inner[b] for b in raw[:-1]] + [last[raw[-1]]]
        return merge_symbols([s for s in symbols if s is not None], self.ranks)

    def word_batch(self, words: list[str]) -> list[bytes]:
        """Ids of many words, as little-endian unsigned 32-bit integers; words of a like
        length share a forest of trees."""
        raw = [w.encode() for w in words]
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = min(self._inner.min(), self._last.min()) >= 0
        classes = np.maximum(1, np.ceil(np.log2(np.maximum(lengths - 1, 1)))).astype(np.int64)
        for c in np.unique(classes):
            at = np.flatnonzero(classes == c)
            if c > 7 or not whole:  # few and long, or symbols that the vocabulary lacks
                for k in at:
                    out[k] = np.array(self.word(words[k]), "<u4").tobytes()
                continue
            size = 1 << int(c)
            for cut in range(0, len(at), FOREST // size + 1):
                part = at[cut : cut + FOREST // size + 1]
                n = lengths[part]
                flat = np.frombuffer(b"".join([raw[k].ljust(size + 1, b"\0") for k in part]), np.uint8).reshape(len(part), size + 1)
                ids = self._inner[flat]
                ids[np.arange(len(part)), n - 1] = self._last[flat[np.arange(len(part)), n - 1]]
                ids[np.arange(size + 1)[None, :] >= n[:, None]] = -1
                merged = merge_forest(ids, n, self.table)
                keep = merged >= 0
                ends = (4 * np.cumsum(keep.sum(1))).tolist()
                flat_ids = merged[keep].astype("<u4").tobytes()
                start = 0
                for k, end in zip(part.tolist(), ends):
                    out[k] = flat_ids[start:end]
                    start = end
        return out

    @property
    def library(self):
        """The library's own encoder."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def segments(self, text: str) -> list[str]:
        """The text cut so that special strings stand alone, at the odd places."""
        return self._special.split(text) if "<|" in text else [text]

    def chunks(self, text: str) -> list[str]:
        """Normalised stretches between white space; no piece crosses them. Those with code points
        of ``_DRIFT`` are as they came, for the library to normalise."""
        if not text.isascii() and _DRIFT.search(text):
            return [x for chunk in _SPACE.split(text) if chunk for x in ([chunk] if _DRIFT.search(chunk) else self.chunks(chunk))]
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # no final form
            text = text.replace("Σ", "σ")
        text = text.lower()
        return [c for c in _SPACE.split(text) if c] if _ODD.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.segments(text)):
            if k % 2:
                ids.append(self.special[part])
            else:
                for chunk in self.chunks(part):
                    if _DRIFT.search(chunk):
                        ids += self.library.encode(chunk, add_special_tokens=False).ids
                        continue
                    for piece in _PIECES.findall(chunk):
                        ids += self.word(piece)
        return ids

    def decode(self, ids) -> str:
        """Tokens joined by blanks, special ones included, as for a file without a decoder."""
        token = self.token
        return " ".join([token[i] for i in ids])


def pieces_of(chunk: str) -> list[str]:
    if chunk.isalpha():
        return [chunk]
    if chunk[:-1].isalpha() and chunk[-1] in ",.;:!?":
        return [chunk[:-1], chunk[-1]]
    return _PIECES.findall(chunk)


class ChunkMemo:
    """chunk -> what ``made`` makes of its ids (None: the ids as they are, little-endian unsigned
    32-bit integers). Two generations of MEMO / 2 entries: when the young one is full it becomes the
    old one, and what is met again there comes back without being merged anew."""

    def __init__(self, codec: Codec, made=None) -> None:
        self.codec, self.made = codec, made
        self.young: dict = {}
        self.old: dict = {}

    def learn(self, lacking: set[str]) -> None:
        """Fills in chunks that neither generation has."""
        words, rest, drift = [], [], []
        for chunk in lacking:
            if not chunk.isascii() and _DRIFT.search(chunk):
                drift.append(chunk)
            elif chunk.isalpha():
                words.append(chunk)
            else:
                rest.append(chunk)
        pieces = list(map(pieces_of, rest))
        ids = dict.fromkeys(words)
        need = {w for p in pieces for w in p} - ids.keys()
        if self.made is None:  # a word may be known as a chunk
            ids.update((w, x) for w in need if (x := self.young.get(w) or self.old.get(w)))
            need -= ids.keys()
        todo = [*words, *need]
        ids.update(zip(todo, self.codec.word_batch(todo)))
        got = {c: np.array(self.codec.library.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in drift}
        got.update(zip(words, map(ids.__getitem__, words)))
        got.update((c, b"".join([ids[w] for w in p])) for c, p in zip(rest, pieces))
        if len(self.young) + len(got) > MEMO // 2:
            self.old, self.young = self.young, {}
        self.young.update(got if self.made is None else zip(got, map(self.made, got.values())))

    def parts(self, texts: list[str]):
        """For each text the list of what was made of its chunks and special strings."""
        flat, found, ends, marks = [], [], [], []
        get = self.young.get
        for text in texts:
            for k, s in enumerate(self.codec.segments(text)):
                if k % 2:  # the empty string, which is no chunk, keeps its place
                    marks.append((len(flat), s))
                    flat.append("")
                    found.append(None)
                else:
                    chunks = self.codec.chunks(s)
                    flat += chunks
                    found += map(get, chunks)
            ends.append(len(flat))
        misses = [i for i, x in enumerate(found) if x is None]
        if misses:
            missing = {flat[i] for i in misses} - {""}
            again = {c: x for c in missing if (x := self.old.get(c)) is not None}
            if len(self.young) + len(again) > MEMO // 2:
                self.old, self.young = self.young, {}
            self.young.update(again)
            missing -= again.keys()
            if missing:
                self.learn(missing)
            get = self.young.get
            for i in misses:
                found[i] = get(c := flat[i]) or again.get(c, b"")
        for i, s in marks:
            raw = np.array([self.codec.special[s]], "<u4").tobytes()
            found[i] = raw if self.made is None else self.made(raw)
        start = 0
        for end in ends:
            yield found[start:end]
            start = end


def as_text(codec: Codec):
    """Ids as decimal text and decoded text, both joined by blanks."""
    text = [str(i) for i in range(max(codec.token) + 1)].__getitem__
    token = codec.token.__getitem__

    def made(raw: bytes) -> tuple[str, str]:
        ids = struct.unpack(f"<{len(raw) // 4}I", raw)
        return " ".join(map(text, ids)), " ".join(map(token, ids))

    return made


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=4)
def memo(path: str, kind: str) -> ChunkMemo:
    book = codec(path)
    return ChunkMemo(book, as_text(book) if kind == "text" else None)


def id_list(raw: list[bytes]) -> pa.Array:
    """array<int> from each row's ids as bytes, without a Python integer for any."""
    ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))


def encode_batches(batches, path: str, text: str, out: str):
    known = memo(path, "bytes")
    for batch in batches:
        raw = [b"".join(p) for p in known.parts(texts_of(batch.column(text)))]
        yield pa.RecordBatch.from_arrays([*batch.columns, id_list(raw)], [*batch.schema.names, out])


def decode_batches(batches, path: str, ids: str, out: str):
    book = codec(path)
    for batch in batches:
        texts = [book.decode(x or ()) for x in batch.column(ids).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])


def digest_batches(batches, path: str):
    known, sha = memo(path, "text"), hashlib.sha256
    for batch in batches:
        n, coded, decoded = [], [], []
        for parts in known.parts(texts_of(batch.column("text"))):
            ids, tokens = map(" ".join, zip(*parts)) if parts else ("", "")
            n.append(ids.count(" ") + 1 if ids else 0)
            coded.append(sha(ids.encode()).hexdigest())
            decoded.append(sha(tokens.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _path(folder: str | None) -> str:
    return vocabulary_path(VOCABULARY, folder)


def encode(df: DataFrame, text: str = "text", out: str = "ids", folder: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text`` as array<int>. One pass, no shuffle."""
    bound_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(remote(__name__, "encode_batches", path=_path(folder), text=text, out=out), schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", folder: str | None = None) -> DataFrame:
    """``df`` with the text of ``ids``."""
    bound_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return df.mapInArrow(remote(__name__, "decode_batches", path=_path(folder), ids=ids, out=out), schema)


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass and returns digests, so that neither the ids nor the
    decoded texts of the corpus have to leave the worker that made them."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(remote(__name__, "digest_batches", path=_path(folder)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

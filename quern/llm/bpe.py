"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

Leaf i of the tree stands for the pair of the live node that begins at byte i and the live node after it; it holds the
pair's rank, and every inner node the leftmost minimum below it (ranks are stored as rank * size + position, so the plain
minimum is the leftmost one). A merge reads the root, joins two nodes and updates three leaves in logarithmic time.
Short pieces are merged together, as the rows of one array of trees; long ones in a tree of their own.

Texts consist of a bounded set of frequent segments and many rare ones, so each worker remembers segments it has encoded,
up to a fixed number. A segment ends where a single space stands between two visible characters: the pattern
always breaks there, so segments are encoded apart without changing a single id.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.shared import unused

NONE = np.int64(1) << 62
LONG = 64
_CUT = re.compile(r"(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")
_RARE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RARE_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"


def segments(text: str) -> list:
    """Pieces of a text, cut only where the pattern always breaks: (first,), then the others without the space before them."""
    plain = text and text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and "\n " not in text
    if plain and not (any(c in text for c in _RARE_ASCII) if text.isascii() else _RARE.search(text)):
        found = text.split(" ")
    else:
        found = _CUT.split(text)
    found[0] = (found[0],)
    return found


def spelled(seg) -> str:
    return seg[0] if isinstance(seg, tuple) else " " + seg


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairs:
    """Encoder and decoder of a table of ranks (token bytes -> rank, which is the id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.full(256, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte_ids[token[0]] = rank
        assert (self.byte_ids >= 0).all(), "a rank table has all single bytes"
        keys, made = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.pairs = dict(zip(keys, made, strict=True))
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        flat = bytearray(int(self.begins[-1]))
        for token, rank in ranks.items():
            flat[self.begins[rank] : self.begins[rank] + len(token)] = token
        self.flat = np.frombuffer(bytes(flat), np.uint8)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they don't merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def _together(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        """Ids of pieces of 2 to ``size`` bytes; size is a power of two."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rows = np.repeat(np.arange(n), length)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        token = np.full((n, size + 1), -1, np.int64)
        token[rows, cols] = flat
        after = np.minimum(np.arange(1, size + 2), length[:, None])  # the live node after each; its own length at the end
        before = np.tile(np.arange(-1, size), (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        a, b = token[:, : size - 1], token[:, 1:size]
        rank = np.where(b >= 0, self.pair_ranks(a, b), NONE)
        tree[:, size : 2 * size - 1] = np.where(rank < NONE, rank * size + np.arange(size - 1), NONE)
        k = size
        while k > 1:
            np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2], out=tree[:, k // 2 : k])
            k //= 2
        live = np.arange(n)
        while len(live):
            top = tree[live, 1]
            live = live[top < NONE]
            top = top[top < NONE]
            if not len(live):
                break
            i, made = top % size, top // size
            j = after[live, i]
            k, p = after[live, j], before[live, i]
            token[live, i] = made
            token[live, j] = -1
            after[live, i] = k
            has = k < length[live]
            before[live[has], k[has]] = i[has]
            right = np.where(has, self.pair_ranks(made, token[live, np.where(has, k, i)]), NONE)
            left = np.where(p >= 0, self.pair_ranks(token[live, np.maximum(p, 0)], made), NONE)
            tree[live, size + j] = NONE
            tree[live, size + i] = np.where(right < NONE, right * size + i, NONE)
            had = p >= 0
            tree[live[had], size + p[had]] = np.where(left[had] < NONE, left[had] * size + p[had], NONE)
            up = [size + i, size + j, size + np.where(had, p, i)]
            while up[0][0] > 1:
                up = [u >> 1 for u in up]
                for u in up:
                    tree[live, u] = np.minimum(tree[live, 2 * u], tree[live, 2 * u + 1])
        keep = token[:, :size] >= 0
        return np.split(token[:, :size][keep], np.cumsum(keep.sum(1))[:-1])

    def _alone(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece, with a tree of its own."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        token: list[int] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, pairs = int(NONE), self.pairs
        tree = np.full(2 * size, NONE, np.int64)
        ids = np.array(token, np.int64)
        rank = self.pair_ranks(ids[:-1], ids[1:])
        tree[size : size + n - 1] = np.where(rank < NONE, rank * size + np.arange(n - 1), NONE)
        k = size
        while k > 1:
            np.minimum(tree[k : 2 * k : 2], tree[k + 1 : 2 * k : 2], out=tree[k // 2 : k])
            k //= 2
        tree = tree.tolist()

        def put(i: int, rank: int | None) -> None:
            value = none if rank is None else rank * size + i
            u = size + i
            tree[u] = value
            while u > 1:
                other = tree[u ^ 1]
                value = value if value < other else other
                u >>= 1
                if tree[u] == value:
                    return
                tree[u] = value

        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            j = after[i]
            k = after[j]
            token[i], token[j], after[i] = rank, -1, k
            put(j, None)
            if k < n:
                before[k] = i
                put(i, pairs.get(rank << 32 | token[k]))
            else:
                put(i, None)
            p = before[i]
            if p >= 0:
                put(p, pairs.get(token[p] << 32 | rank))
        return np.array([t for t in token if t >= 0], np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, a match of the pattern."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int64)
            elif len(p) > LONG:
                out[i] = self._alone(p)
            else:
                groups.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for size, at in groups.items():
            for a in range(0, len(at), 8192):
                part = at[a : a + 8192]
                for i, ids in zip(part, self._together([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def encode_segments(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after the other, and their number for each."""
        found = list(map(self.pattern.findall, segs))
        unique = list({p: None for f in found for p in f})
        ids = dict(zip(unique, self.encode_pieces([p.encode() for p in unique]), strict=True))
        flat = [ids[p] for f in found for p in f]
        if not flat:
            return np.zeros(0, np.int64), np.zeros(len(segs), np.int64)
        ends = np.cumsum([len(x) for x in flat])
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, found)])]
        return np.concatenate(flat), np.diff(upto)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_segments([spelled(s) for s in segments(text)])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, one after the other."""
        n = self.lengths[ids]
        to = np.cumsum(n)
        at = np.repeat(self.begins[ids] - (to - n), n)
        at += np.arange(len(at))
        return self.flat[at].tobytes()


class Remembered:
    """Ids of segments, each encoded once while it is remembered.

    ``encode`` gives the ids of a list of segments and their numbers. At most ``cap`` segments are remembered, or those of
    one slice of texts; beyond that the half used most stays. ``wide`` also keeps ids as decimal text.
    """

    SLICE = 1_000_000

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cap: int, wide: bool):
        self.encode, self.cap, self.wide = encode, cap, wide
        self._clear()

    def _clear(self) -> None:
        self.index: dict = {}
        self.used, self.count, self.begin = (np.zeros(1024, np.int64) for _ in range(3))
        self.flat, self.size = np.zeros(4096, np.int32), 0
        self.said: list[str] = []

    def _add(self, segs: list, ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self.index), len(segs)
        if n + m > len(self.used):
            for name in ("used", "count", "begin"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(n + m, np.int64)]))
        self.begin[n : n + m] = self.size + np.cumsum(counts) - counts
        self.count[n : n + m] = counts
        self.used[n : n + m] = 0
        total = self.size + len(ids)
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(total, np.int32)])
        self.flat[self.size : total] = ids
        self.size = total
        self.index.update(zip(segs, range(n, n + m), strict=True))
        if self.wide:
            words = list(map(str, ids.tolist()))
            ends = np.cumsum(counts).tolist()
            self.said += [" ".join(words[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _shrink(self) -> None:
        n = len(self.index)
        best = np.sort(np.argsort(-self.used[:n], kind="stable")[: self.cap // 2])
        names, used, counts = list(self.index), self.used[best] // 2, self.count[best]
        ids = self._gather(best)
        self._clear()
        self._add([names[i] for i in best.tolist()], ids, counts)
        self.used[: len(best)] = used

    def _gather(self, idx: np.ndarray) -> np.ndarray:
        n = self.count[idx]
        to = np.cumsum(n)
        src = np.repeat(self.begin[idx] - (to - n), n)
        src += np.arange(len(src))
        return self.flat[src]

    def _indices(self, parts: list[list], total: int) -> np.ndarray:
        look = lambda: np.fromiter(map(self.index.get, chain.from_iterable(parts), repeat(-1)), np.int64, total)
        idx = look()
        if (idx < 0).any():
            if len(self.index) + int((idx < 0).sum()) > self.cap and len(self.index) > self.cap // 2:
                self._shrink()
                idx = look()
            miss = np.flatnonzero(idx < 0)
            segs = list(chain.from_iterable(parts))
            names = [segs[i] for i in miss.tolist()]
            new = list(dict.fromkeys(names))
            self._add(new, *self.encode([spelled(s) for s in new]))
            idx[miss] = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        return idx

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the indices of its segments and its ids."""
        at = 0
        while at < len(texts):  # a slice of texts at once
            parts, total = [], 0
            while at < len(texts) and (not parts or total < self.SLICE):
                parts.append(segments(texts[at]))
                total += len(texts[at])
                at += 1
            ends = np.cumsum([len(p) for p in parts])
            idx = self._indices(parts, int(ends[-1]))
            self.used += np.bincount(idx, minlength=len(self.used))
            ids = self._gather(idx)
            upto = np.concatenate([[0], np.cumsum(self.count[idx])])
            a = 0
            for b in ends.tolist():
                yield idx[a:b], ids[upto[a] : upto[b]]
                a = b

    def text(self, idx: np.ndarray) -> str:
        return " ".join(filter(None, map(self.said.__getitem__, idx.tolist())))


_loaded: dict[tuple, tuple[BytePairs, Remembered]] = {}


def encoder(path: str, pattern: str, cap: int) -> tuple[BytePairs, Remembered]:
    """One per worker process and vocabulary."""
    key = (path, pattern, cap)
    if key not in _loaded:
        b = BytePairs(load_ranks(path), pattern)
        _loaded[key] = (b, Remembered(b.encode_segments, cap, wide=True))
    return _loaded[key]


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", cap: int = 500_000) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) of each whole text; a null or empty text has none. A column ids is replaced."""
    rest = [c for c in docs.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memory = encoder(path, pattern, cap)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for i in range(0, len(batch), 256):
                ids = [x for _, x in memory.of(_texts(texts.slice(i, 256)))]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 256) for c in batch.columns[:-1]), pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names[:-1], "ids"])

    (own,) = unused(docs.columns, "_text")
    source = docs.select(*(f"`{c}`" for c in rest), F.col(f"`{text}`").cast("string").alias(own))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "ids array<int>"])
    return source.mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "ids", cap: int = 500_000) -> DataFrame:
    """``rows`` with ``decoded`` (binary), the bytes of its ids; null ids give null."""
    rest = [c for c in rows.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, _ = encoder(path, pattern, cap)
        for batch in batches:
            found = batch.column(batch.num_columns - 1)
            out = [None if x is None else pairs.decode(np.array(x, np.int64)) for x in found.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "decoded"])

    (own,) = unused(rows.columns, "_ids")
    source = rows.select(*(f"`{c}`" for c in rest), F.col(f"`{ids}`").alias(own))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "decoded binary"])
    return source.mapInArrow(run, schema)


def bpe_digest(docs: DataFrame, path: str, pattern: str, cap: int = 500_000) -> DataFrame:
    """Query op7: per document the number of ids, and digests of the ids and of the bytes they decode to.

    Encoding and decoding happen in one pass, so that no ids are shuffled or stored. A null text is empty. Repeated rows
    are encoded each; an empty table gives an empty result. doc_id keeps its type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, memory = encoder(path, pattern, cap)
        for batch in batches:
            raw, off = W.buffer(batch.column(1))
            for i, j in W.slices(off, 4_000_000):
                n, a, b = [], [], []
                for idx, ids in memory.of(_texts(batch.column(1).slice(i, j - i))):
                    n.append(len(ids))
                    a.append(hashlib.sha256(memory.text(idx).encode()).hexdigest())
                    b.append(hashlib.sha256(pairs.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

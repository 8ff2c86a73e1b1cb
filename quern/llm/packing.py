"""Packing by vector bin packing with the dot-product heuristic.

An example demands tokens, one segment, and loss-bearing tokens; a sequence offers at most so many of each. The open
sequence takes, of the waiting examples that fit, the one whose demand has the largest dot product with what is left, each
dimension divided by its limit. A bounded pool of examples waits, so a task needs bounded memory, and tasks pack apart.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bpe
from quern.llm import words as W
from quern.llm.shared import unused


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Packer:
    """Places pieces into sequences; ``placed`` collects (key, sequence, offset, length, start)."""

    def __init__(self, limits: Limits, cut: bool, pool: int = 256, first: int = 0):
        self.limits, self.cut, self.pool = limits, cut, pool
        self.most = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.demand = np.zeros((pool + 1, 3))
        self.waiting: list[tuple] = []  # (key, start, length, loss)
        self.placed: list[tuple] = []
        self.next = first
        self._open()

    def _fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def _open(self) -> None:
        self.sequence = self._fresh()
        self.room = self.most.copy()
        self.offset = 0

    def _close(self) -> None:
        if self.offset:
            self._open()

    def _put(self, key, start: int, length: int, loss: int) -> None:
        self.placed.append((key, self.sequence, self.offset, length, start))
        self.offset += length
        self.room -= (length, 1, loss)

    def _take(self, i: int) -> tuple:
        """Remove waiting[i]; the last one moves into its place."""
        item, last = self.waiting[i], self.waiting.pop()
        if i < len(self.waiting):
            self.waiting[i] = last
            self.demand[i] = self.demand[len(self.waiting)]
        return item

    def _best(self) -> int:
        n = len(self.waiting)
        d = self.demand[:n]
        fits = (d <= self.room).all(1)
        if not fits.any():
            return -1
        score = np.where(fits, (d / self.most) @ (self.room / self.most), -1.0)
        return int(score.argmax())

    def add(self, key, length: int, loss: int, start: int = 0) -> None:
        """An example of ``length`` tokens, of which the last ``loss`` bear loss if it is cut."""
        n, most = self.limits, self.limits.tokens
        if self.cut:
            while length >= most and n.segments and n.loss >= most:  # full sequences of its own
                self.placed.append((key, self._fresh(), 0, most, start))
                start, length, loss = start + most, length - most, max(0, min(loss, length - most))
        elif length > most or loss > n.loss:
            raise ValueError(f"an example of {length} tokens, {loss} of them with loss, exceeds the limits; cut or drop it first")
        if length:
            self.demand[len(self.waiting)] = (length, 1, loss)
            self.waiting.append((key, start, length, loss))
            while len(self.waiting) > self.pool:
                self._step()

    def _step(self) -> None:
        i = self._best()
        if i >= 0:
            self._put(*self._take(i))
            return
        space, loss = int(self.room[0]), int(self.room[2])
        part = min(space, loss)
        if self.cut and part > 0 and self.room[1] >= 1:  # nothing fits whole: cut the longest to fill the rest
            i = int(self.demand[: len(self.waiting), 0].argmax())
            key, start, length, bears = self.waiting[i]
            part = min(part, length - 1)
            self._put(key, start, part, min(bears, part))
            left = length - part
            self.waiting[i] = (key, start + part, left, min(bears, left))
            self.demand[i] = (left, 1, min(bears, left))
        self._close()

    def drain(self) -> list[tuple]:
        out, rest = [], []
        for p in self.placed:
            (rest if p[1] == self.sequence else out).append(p)
        self.placed = rest
        return out

    def finish(self) -> list[tuple]:
        while self.waiting:
            if self.cut and sum(w[2] for w in self.waiting) + self.offset < self.limits.tokens:
                break
            self._step()
        if self.waiting:
            self._tail()
        return self.placed

    def _tail(self) -> None:
        """The last tokens of a task, fewer than a sequence: cut into powers of two, which need no padding."""
        own = [p for p in self.placed if p[1] == self.sequence]
        self.placed = [p for p in self.placed if p[1] != self.sequence]
        items = [[k, start, length] for k, _, _, length, start in own] + [[k, s, n] for k, s, n, _ in self.waiting]
        self.waiting = []
        total = sum(x[2] for x in items)
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            space, offset, used, sequence = 1 << bit, 0, 0, self._fresh()
            while space:
                if used == self.limits.segments:  # goes on in another sequence
                    sequence, offset, used = self._fresh(), 0, 0
                k, s, n = items[0]
                part = min(n, space)
                self.placed.append((k, sequence, offset, part, s))
                offset, space, used = offset + part, space - part, used + 1
                items[0][1], items[0][2] = s + part, n - part
                if n == part:
                    items.pop(0)


#: Sequence ids of partition p are from p << SHIFT.
SHIFT = 33


def pack_examples(rows: DataFrame, tokens: str, loss: str, limits: Limits = Limits(), pool: int = 256) -> DataFrame:
    """Instruction examples, never cut: ``rows`` with ``sequence_id`` and ``offset`` (tokens before it in its sequence).

    Null or negative lengths count as 0, and loss as no more than the tokens; an example of no tokens gets sequence_id and offset null.
    An example beyond a limit raises. Rows of a partition are packed together, in their order of arrival, and all other
    columns ride along; columns named sequence_id or offset are replaced.
    """
    rest = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    length = F.greatest(F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0)), F.lit(0))
    own = unused(rows.columns, "_tokens", "_loss", "_part")
    source = rows.select(*(f"`{c}`" for c in rest), length.alias(own[0]), F.least(F.greatest(F.coalesce(F.col(f"`{loss}`").cast("long"), F.lit(0)), F.lit(0)), length).alias(own[1]), F.spark_partition_id().alias(own[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer: Packer | None = None
        held: dict[int, pa.RecordBatch] = {}
        open_rows: dict[int, int] = {}
        for k, batch in enumerate(batches):
            if not len(batch):
                continue
            n, m, part = (batch.column(batch.num_columns - c).to_pylist() for c in (3, 2, 1))
            packer = packer or Packer(limits, cut=False, pool=pool, first=part[0] << SHIFT)
            plain = batch.select(batch.schema.names[:-3])
            held[k], open_rows[k] = plain, 0
            empty = [i for i, x in enumerate(n) if not x]
            if empty:
                yield _with(plain.take(pa.array(empty)), [None] * len(empty), [None] * len(empty))
            for i, (x, y) in enumerate(zip(n, m, strict=True)):
                if x:
                    open_rows[k] += 1
                    packer.add((k, i), x, y)
            yield from _release(packer.drain(), held, open_rows)
        if packer:
            packer.finish()
            yield from _release(packer.placed, held, open_rows)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-3]), "sequence_id bigint, offset bigint"])
    return source.mapInArrow(run, schema)


def _with(rows: pa.RecordBatch, sequence: list, offset: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*rows.schema.names, "sequence_id", "offset"])


def _release(placed: list[tuple], held: dict, open_rows: dict) -> Iterator[pa.RecordBatch]:
    by: dict[int, list] = {}
    for (k, i), s, o, _, _ in placed:
        by.setdefault(k, []).append((i, s, o))
    for k, xs in by.items():
        i, s, o = (list(x) for x in zip(*xs, strict=True))
        yield _with(held[k].take(pa.array(i)), s, o)
        open_rows[k] -= len(xs)
    for k in [k for k, n in open_rows.items() if not n and k in by]:
        del held[k], open_rows[k]


_loaded: dict[tuple, tuple] = {}


class Vocabulary:
    """Ids of whole texts by a file of tokenizers, as its ``encode`` gives them without special tokens added.

    Strings of the file's added tokens are their ids, wherever they stand in a text. What lies between them is encoded by
    remembered segments; if an added token takes in its neighbours, tokenizers encodes the texts that hold one.
    """

    def __init__(self, tokenizer, memory: bpe.Remembered):
        self.tokenizer, self.memory = tokenizer, memory
        added = tokenizer.get_added_tokens_decoder()
        self.ids = {t.content: i for i, t in added.items()}
        self.apart = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values())
        self.names = sorted(filter(None, self.ids), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, self.names))})")

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not any(name in t for name in self.names for t in texts):  # a plain search is faster than the pattern's
            for _, ids in self.memory.of(texts):
                yield ids
            return
        parts = [self.special.split(t) if self.apart or not self.special.search(t) else None for t in texts]
        plain = self.memory.of([x for p in parts if p for x in p[::2]])
        for t, p in zip(texts, parts, strict=True):
            if p is None:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int64)
            else:
                yield np.concatenate([np.array([self.ids[x]]) if i % 2 else next(plain)[1] for i, x in enumerate(p)])


def _json_vocabulary(path: str, pattern: str, cap: int) -> Vocabulary:
    """Encoder by a byte-level BPE file of tokenizers.

    Ids of segments come from tiktoken's merge loop over the file's own vocabulary, which is several times faster. That
    is right only where merges are ordered as ids, which is checked here, as are the ids of a probe; otherwise
    tokenizers encodes the segments itself.
    """
    key = (path, pattern, cap)
    if key in _loaded:
        return _loaded[key]
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def plain(segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, np.int64) for e in own.encode_batch_fast(segs, add_special_tokens=False)]
        return np.concatenate(ids), np.array([len(x) for x in ids])

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from U+0100
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    vocabulary = {t: i for t, i in model["vocab"].items() if all(c in byte for c in t)}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ordered = [vocabulary.get(m) for m in merged]
    first = {bytes([b]) for b in range(256)} <= ranks.keys() and ordered == sorted(ordered) and len(set(ordered)) == len(ordered)
    singles = [r for t, r in ranks.items() if len(t) == 1]
    encode = plain
    if first and ordered and max(singles) < ordered[0]:
        special = [t for t in ranks if len(t) > 1 and ranks[t] < ordered[0] or ranks[t] > ordered[-1]]
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: r for t, r in ranks.items() if t not in special}, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            size[r] = len(t)

        def quick(segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Joined, then cut where the bytes of each end; only a segment that begins with its space can be joined on."""
            found, counts = [], []
            a = 0
            while a < len(segs):
                b = a + 1
                while b < len(segs) and b - a < 4096 and segs[b][:1] == " " and segs[b - 1][-1:] not in blanks:
                    b += 1
                ids = np.array(fast.encode_ordinary("".join(segs[a:b])), np.int64)
                ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(s.encode()) for s in segs[a:b]]), side="right")
                found.append(ids)
                counts.append(np.diff(ends, prepend=0))
                a = b
            return np.concatenate(found), np.concatenate(counts)

        blanks = {"", *(chr(c) for c in range(0x3001) if chr(c).isspace())}
        probe = [" the", "It's 12", " naïve—\n\n x", " 😀  y", "\tz ", "", " übermäßig.", "<|x|>"]
        if all((x == y).all() for x, y in zip(quick(probe), plain(probe), strict=True)):
            encode = quick
    _loaded[key] = Vocabulary(own, bpe.Remembered(encode, cap, wide=False))
    return _loaded[key]


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, n_loss bigint"


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 1, limits: Limits = Limits(), pool: int = 256, cap: int = 1_000_000) -> DataFrame:
    """Query op3: all documents as pieces of sequences of at most ``limits.tokens`` ids, cut freely.

    A document is the ids of its whole text (null: empty) by the vocabulary, then ``end_id``. Every id lies in one
    piece; the first id of a piece bears no loss, as nothing stands before it. Sequences are full but for the last ones
    of a task, which are powers of two. Each task packs its rows alone, so nothing is shuffled, and a task that is run again gives the
    same rows. Repeated rows are packed each; null ids ride along, doc_id keeps its type; an empty table gives no piece.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _json_vocabulary(vocabulary, pattern, cap)
        packer: Packer | None = None
        ids: dict[int, list] = {}  # row -> doc_id, ids, ids not yet given out
        at = 0

        def out(placed: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(8)]
            for key, seq, offset, length, start in placed:
                doc, own, left = ids[key]
                cut = own[start : start + length]
                for c, v in zip(cols, (doc, start, length, zlib.crc32(cut.tobytes()), len(own), seq, offset, length - 1), strict=True):
                    c.append(v)
                if left == length:
                    del ids[key]
                else:
                    ids[key][2] = left - length
            names = ["doc_id", *(x.split()[0] for x in PIECES.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for batch in batches:
            if not len(batch):
                continue
            packer = packer or Packer(limits, cut=True, pool=pool, first=batch.column(2)[0].as_py() << SHIFT)
            _, off = W.buffer(batch.column(1))
            for i, j in W.slices(off, 4_000_000):
                names = batch.column(0).slice(i, j - i).to_pylist()
                for doc, own in zip(names, memory.of(bpe._texts(batch.column(1).slice(i, j - i))), strict=True):
                    own = np.append(own, end_id).astype("<u4")
                    ids[at] = [doc, own, len(own)]
                    packer.add(at, len(own), len(own) - 1)
                    at += 1
                yield out(packer.drain(), batch.column(0).type)
        if packer:
            yield out(packer.finish(), batch.column(0).type)

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part")).mapInArrow(run, f"doc_id {kind}, {PIECES}")

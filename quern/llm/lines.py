"""Fuzzy line deduplication across all documents, keeping one line per component.

A line is compared without regard to A-Z case and white space at its ends, as its set of character shingles. The hash of
each shingle picks one of REGISTERS buckets, which keep their least value (one-permutation MinHash); bands of registers
give candidates, exact Jaccard similarity of the whole sets settles them, and distributed union-find joins the links.

Each text is cut into lines once. Lines that a task sees again go no further; of the others the compared form travels to
where its digest is dealt, and only the first of each is signed and saved, so later steps never read a document again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import linking as L
from quern.llm import words as W
from quern.llm.shared import drop, save

#: Bands of BAND_ROWS registers: a pair at 0.8 shares one of 16 with probability 0.99999.
REGISTERS, BAND_ROWS = 48, 3
SHINGLE, PERCENT = 9, 80
#: Bytes of lines among which a task looks for repeats at once.
CHUNK = 16_000_000


def _trimmed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the white space at their ends; blank ones become empty."""
    some = ends > starts
    loose = np.flatnonzero(some)[W.SPACE[raw[starts[some]]] | W.SPACE[raw[ends[some] - 1]]]
    if not len(loose):
        return starts, ends
    ink = np.flatnonzero(~W.SPACE[raw])
    starts, ends = starts.copy(), ends.copy()
    a, b = np.searchsorted(ink, starts[loose]), np.searchsorted(ink, ends[loose])
    blank = b <= a
    ends[loose[blank]] = starts[loose[blank]]
    a, b, loose = a[~blank], b[~blank], loose[~blank]
    starts[loose], ends[loose] = ink[a], ink[b - 1] + 1
    return starts, ends


_WEIGHTS = [W.U(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)]


def _weighed(view: np.ndarray, begin: np.ndarray, size: np.ndarray | int, least: int) -> np.ndarray:
    """Hashes of shingles of ``least`` bytes or more, 8 bytes at a time; those behind a shingle are masked."""
    x = np.asarray(size).astype(W.U) * W.U(0xA24BAED4963EE407)
    for j in range(0, int(np.max(size, initial=0)), 8):
        weight = _WEIGHTS[j // 8]
        if j + 8 <= least:
            x = x + view[begin + j] * weight
        elif np.ndim(size) == 0:
            x = x + (view[begin + j] & W._KEEP[size - j]) * weight
        elif j < least:
            x = x + (view[begin + j] & W._KEEP[np.clip(size - j, 0, 8)]) * weight
        else:  # few are so long
            some = np.flatnonzero(size > j)
            x[some] += (view[begin[some] + j] & W._KEEP[np.minimum(size[some] - j, 8)]) * weight
    return W.mix(x)


def char_shingles(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-character shingles (k <= 16) of each span of UTF-8 bytes; a shorter span has one, an empty one none."""
    if not len(part):
        return np.zeros(0, W.U), np.zeros(len(starts) + 1, np.int64)
    view = np.concatenate([W.eights(part), np.zeros(64, W.U)])
    plain = part.max() < 0x80  # a character is a byte
    heads = np.arange(1) if plain else np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
    a, b = (starts, ends) if plain else (np.searchsorted(heads, starts), np.searchsorted(heads, ends))
    n = b - a
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    off = np.concatenate([[0], np.cumsum(count)])
    begin = np.arange(off[-1]) + np.repeat(a - off[:-1], count)
    size: np.ndarray | int = k
    if not plain:
        stop = heads[np.minimum(begin + k, len(heads) - 1)]
        begin = heads[begin]
        size = stop - begin
    h = _weighed(view, begin, size, k)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        h[off[short]] = _weighed(view, starts[short], (ends - starts)[short], 1)
    return h, off


def signature(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One-permutation MinHash registers of 16 bits: the upper half of a hash picks the register, the lower half is its value."""
    bucket = ((h >> W.U(32)) * W.U(REGISTERS) >> W.U(32)).astype(np.int64)
    owner = np.repeat(np.arange(len(off) - 1) * REGISTERS, np.diff(off))
    none = np.uint32(0xFFFFFFFF)
    least = np.full((len(off) - 1) * REGISTERS, none, np.uint32)
    np.minimum.at(least, owner + bucket, h.astype(np.uint32))
    sig = np.minimum((least * np.uint32(0x9E3779B1)) >> np.uint32(16), np.uint32(0xFFFE)).astype(np.uint16)
    sig[least == none] = L.EMPTY
    return sig.reshape(-1, REGISTERS)


def likely(percent: int):
    """Passes pairs whose equal registers don't speak against the similarity by five standard deviations."""
    t = percent / 100

    def test(sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray) -> np.ndarray:
        used = np.maximum(((sa != L.EMPTY) | (sb != L.EMPTY)).sum(1), 1)
        same = ((sa == sb) & (sa != L.EMPTY)).sum(1)
        return same / used + 5 * np.sqrt(t * (1 - t) / used) >= t

    return test


#: A line's place: the document, the line in it, and a hash of the whole text, which tells rows of one doc_id apart.
PLACE = ["doc_id", "line", "d"]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("d"), text.alias("text"))


def _cut(column: pa.Array) -> Iterator[tuple]:
    """Lines with ink of a column of texts, slice by slice: text, line, two digests and the trimmed lower-case bytes with their offsets."""
    _, off = W.buffer(column)
    for i, j in W.slices(off):
        raw, o = W.buffer(column.slice(i, j - i))
        part = W.LOWER[raw]
        starts, ends, loff = W.line_spans(raw, o)
        starts, ends = _trimmed(raw, starts, ends)
        keep = np.flatnonzero(ends > starts)
        owner = np.repeat(np.arange(j - i), np.diff(loff))[keep]
        line = keep - loff[owner]
        starts, ends = starts[keep], ends[keep]
        edge = np.zeros(len(part) + 1, np.int8)
        edge[starts] = 1
        np.subtract.at(edge, ends, 1)
        inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        yield owner + i, line, *W.span_digests(part, starts, ends), part[inside], np.append(0, np.cumsum(ends - starts))


def _again(h1: np.ndarray, h2: np.ndarray, place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of lines with their digests: the first of each, by place, and those at another place."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    first = np.insert((a[1:] != a[:-1]) | (b[1:] != b[:-1]), 0, True)
    if first.all():
        return np.arange(len(h1)), np.zeros(0, np.int64)
    group = np.cumsum(first) - 1
    several = np.bincount(group)[group] > 1
    some, group = order[several], group[several]
    by = np.lexsort((*(p[some] for p in reversed(place)), group))
    some, group = some[by], group[by]
    lead = np.insert(group[1:] != group[:-1], 0, True)
    leads = some[lead][np.cumsum(lead) - 1]
    other = np.logical_or.reduce([p[some] != p[leads] for p in place])
    return np.sort(np.append(order[~several], some[lead])), some[other]


SENT = "h1 bigint, h2 bigint, doc_id bigint, line int, d bigint, text string"


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line once by chunk, and the places of its repeats without a text, dealt at random."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        doc, d, line, h1, h2 = (np.concatenate([x[c] for x in held]) for c in range(5))
        data = np.concatenate([x[5] for x in held])
        off = np.append(0, np.cumsum(np.concatenate([np.diff(x[6]) for x in held])))
        texts = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data))
        first, again = _again(h1, h2, [doc, line, d])
        both = np.append(first, again)
        h1[again] = W.mix(d[again].view(W.U) + line[again].astype(W.U)).view(np.int64)
        text = pa.concat_arrays([texts.take(pa.array(first)).cast(pa.string()), pa.nulls(len(again), pa.string())])
        return pa.RecordBatch.from_arrays([*(pa.array(x[both]) for x in (h1, h2, doc)), pa.array(line[both].astype(np.int32)), pa.array(d[both]), text], [x.split()[0] for x in SENT.split(", ")])

    for batch in batches:
        ids, digest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for owner, line, h1, h2, data, off in _cut(batch.column(2)):
            held.append((ids[owner], digest[owner], line, h1.view(np.int64), h2.view(np.int64), data, off))
            size += len(data)
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


LINES = "doc_id bigint, line int, d bigint, sig binary, text string"


def _receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines sorted by digest and place, the first of each with its signature; the others, and repeats, without."""
    last = None  # digest and place of the latest first line
    for batch in batches:
        for a in range(0, len(batch), 4096):
            part = batch.slice(a, 4096)
            h1, h2, *place = (part.column(c).to_numpy() for c in range(5))
            sent = part.column(5).is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(sent)
            fresh = np.zeros(len(part), bool)
            gone = ~sent
            if len(at):
                x, y = h1[at], h2[at]
                new = np.insert((x[1:] != x[:-1]) | (y[1:] != y[:-1]), 0, last is None or last[:2] != (x[0], y[0]))
                fresh[at[new]] = True
                lead = np.maximum.accumulate(np.where(new, at, -1))
                same = np.ones(len(at), bool)
                for p, was in zip(place, last[2:] if last else (0, 0, 0), strict=True):
                    same &= p[at] == np.where(lead >= 0, p[lead], was)
                gone[at[~new & ~same]] = True
                if lead[-1] >= 0:
                    k = lead[-1]
                    last = (h1[k], h2[k], *(p[k] for p in place))
            for i, j in W.slices(W.buffer(part.column(5))[1]):
                texts = part.column(5).slice(i, j - i).filter(pa.array(fresh[i:j]))
                raw, off = W.buffer(texts)
                sig = signature(*char_shingles(raw, off[:-1], off[1:], SHINGLE))
                rest = pa.array(np.flatnonzero(gone[i:j]))
                own = [part.column(c).slice(i, j - i) for c in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(fresh[i:j])) for c in own), W.binaries(sig), texts], LINE_NAMES)
                if len(rest):
                    yield pa.RecordBatch.from_arrays([*(c.take(rest) for c in own), pa.nulls(len(rest), pa.binary()), pa.nulls(len(rest), pa.string())], LINE_NAMES)


LINE_NAMES = [x.split()[0] for x in LINES.split(", ")]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    raw, off = W.buffer(column)
    values, soff = W.distinct(*char_shingles(raw, off[:-1], off[1:], SHINGLE))
    return [values[soff[i] : soff[i + 1]] for i in range(len(soff) - 1)]


def repeated_lines(docs: DataFrame) -> DataFrame:
    """The lines that go: doc_id, line (from 0), d (xxhash64 of the text), some of them more than once; a table in the shared folder.

    Every component keeps its first line by PLACE. Blank lines, null texts and rows with a null doc_id take no part; rows
    equal in doc_id and text are one.
    """
    sent = _texts(docs).mapInArrow(_send, SENT).repartition("h1").sortWithinPartitions("h1", "h2", *PLACE)
    lines = save(sent.mapInArrow(_receive, LINES).withColumn("id", F.monotonically_increasing_id()), "lines")
    whole = lines.where("sig is not null")
    texts = whole.select("id", "text")
    items = whole.select("id", F.lit(1).cast("long").alias("n"), "sig")
    attach = lambda rows: rows.hint("shuffle_hash").join(texts, "id")
    parts = L.link(items, REGISTERS, BAND_ROWS, PERCENT, likely(PERCENT), attach, shingle_sets)

    linked = parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())
    named = whole.select("id", *PLACE).join(linked.withColumnRenamed("node", "id").hint("shuffle_hash"), "id")
    at = F.struct(*PLACE)
    keep = named.groupBy("component").agg(F.min(at).alias("keep"))
    near = named.join(keep, "component").where(at != F.col("keep")).select(*PLACE)
    out = save(lines.where("sig is null").select(*PLACE).unionByName(near), "gone")
    drop(lines, parts)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its text less the lines that repeat, exactly or nearly, a line kept elsewhere; adds n_lines (with ink), removed_lines (their numbers).

    Of each component the first line stays, by doc_id, then line, then a hash of the text. Rows that share a doc_id but not the text
    are documents of their own; rows equal in both are one and come out alike. Rows with a null doc_id stay as they are.
    Other columns stay, columns of the added names are replaced. Null texts stay null; a text whose lines all go is
    empty. An empty table stays empty.
    """
    gone = repeated_lines(docs).groupBy("doc_id", "d").agg(F.array_sort(F.collect_set("line")).alias("removed_lines"))
    names = [c for c in docs.columns if c not in ("n_lines", "removed_lines")]
    at = names.index("text")
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("d"))
    rows = rows.join(gone.hint("shuffle_hash"), ["doc_id", "d"], "left").select(*(F.col("row").getField(c).alias(c) for c in names), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                texts, inked = [], []
                for t, gone in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    lines = [] if t is None else t.split("\n")
                    inked.append(sum(bool(x.strip(" \t\n\v\f\r")) for x in lines))
                    skip = set(gone)
                    texts.append("\n".join(x for n, x in enumerate(lines) if n not in skip) if skip else t)
                cols = list(part.columns)
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(inked, pa.int64())], [*part.schema.names, "n_lines"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "n_lines bigint"])
    return rows.mapInArrow(run, schema)


def line_digest(docs: DataFrame) -> DataFrame:
    """Query op1: doc_id, text without repeated lines, n_lines, n_removed, removed_lines."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "text", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")

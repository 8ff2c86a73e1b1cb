"""Brown class-based bigrams: words fall into classes by the exchange algorithm, classes follow one another, and each class emits its words.

All counts are of the whole training corpus. Frequent words make a dictionary of bounded size that every task holds. Texts
are turned into its numbers once. The most frequent words are exchanged one by one at the driver; then all words of the
dictionary are exchanged in distributed sweeps, a third of them at a time against the classes of the others, until few
move. Counts of the words beyond it stay in distributed tables: each gets the class that the same gain prefers. Words seen
once, and words that never stood beside a clustered one, form one rare class, which also emits words never seen, with the
share of words seen once (Good-Turing).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.shared import drop, save

END = b"\n"  # no word holds white space


@dataclass(frozen=True)
class Settings:
    classes: int = 24
    core: int = 1000  #: most frequent words, which the driver exchanges one by one
    clustered: int = 250_000  #: words that the sweeps exchange, and beside which others are classed
    head: int = 250_000  #: words held by every task, each of at most ``longest`` bytes
    longest: int = 64
    rounds: int = 8
    sweeps: int = 2
    still: float = 0.02  #: sweeps end once words with less than this share of the tokens move
    prior: float = 10.0


def tokens(text: str | None) -> list[bytes]:
    """Words, split at ASCII white space, with A-Z in lower case."""
    return [] if text is None else text.encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c): every token of every text and one END for each. docs: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                c.update(tokens(text))
                c[END] += 1
                if len(c) > 400_000:
                    yield flush()
                    c.clear()
        if c:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each of the n words of ``pairs`` (n, n: counts of word i before word j), the last of which, END, keeps a class of its own.

    Starting from every ``classes``-th word by frequency, each word in turn moves to the class that most raises the
    likelihood of the class bigrams, until a round moves none.
    """
    n = len(pairs)
    k = classes + 1
    of = np.append(np.arange(n - 1) % classes, classes)
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    out, into = pairs @ member, pairs.T @ member  # (n, k): word before class, class before word
    both = member.T @ out
    total = pairs.sum(1)
    size = member.T @ total
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    for _ in range(rounds):
        moved = 0
        for w in range(n - 1):
            a, own = of[w], pairs[w, w]
            r, c = out[w].copy(), into[w].copy()
            r[a] -= own
            c[a] -= own
            both[a] -= r
            both[:, a] -= c
            both[a, a] -= own
            size[a] -= total[w]
            fb = f(both)
            rows, cols = f(both + r) - fb, f(both + c[:, None]) - fb
            diag = np.arange(k)
            gain = rows.sum(1) - rows[diag, diag] + cols.sum(0) - cols[diag, diag]
            gain += f(both[diag, diag] + r + c + own) - fb[diag, diag] - 2 * (f(size + total[w]) - f(size))
            b = int(gain[:classes].argmax())
            if gain[a] >= gain[b] - 1e-9:
                b = a
            both[b] += r
            both[:, b] += c
            both[b, b] += own
            size[b] += total[w]
            if b != a:
                moved += 1
                of[w] = b
                out[:, a] -= pairs[:, w]
                out[:, b] += pairs[:, w]
                into[:, a] -= pairs[w]
                into[:, b] += pairs[w]
        if not moved:
            break
    return of


def _numbers(column: pa.Array, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts one after the other, and where each text begins."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, (off[-1] - off[0]) // size, off[0]), (off[:-1] - off[0]) // size


def _packed(numbers: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The inverse of :func:`_numbers`."""
    off = (np.append(begin, len(numbers)) * numbers.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(numbers))])


#: Tokens whose neighbours are counted at once, words whose counts are summed in one task, and tasks whose counts are summed in a first step.
STRETCH, RANGE, FAN = 2_000_000, 4096, 256
COUNTS = "p int, s int, codes binary, counts binary"


def _stretches(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """The sequences of all texts of a task, some of them at a time, each begun by END. batch: ids binary."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        if len(batch):
            held.append(_numbers(batch.column(0))[0])
            size += len(held[-1])
        if size > STRETCH:
            yield np.concatenate([np.array([end], np.uint32), *held])
            held, size = [], 0
    if size:
        yield np.concatenate([np.array([end], np.uint32), *held])


def _pair_counts(encoded: DataFrame, cls, k: int, end: int) -> np.ndarray:
    """Counts (k, k) of kinds beside each other, ``cls`` giving the kind of each number, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, got = cls.value, np.zeros(k * k, np.int64)
        for s in _stretches(batches, end):
            c = kind[s]
            a, b = c[:-1], c[1:]
            ok = (a >= 0) & (b >= 0)
            got += np.bincount(a[ok].astype(np.int64) * k + b[ok], minlength=k * k)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], ["code", "n"])

    rows = encoded.select("ids").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # k * k at most
    pairs = np.zeros(k * k)
    pairs[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return pairs.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(near: np.ndarray, now: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Rise of the class bigrams' log-likelihood if a word is put into each class, (m, k - 1): the last class is END's.

    near (m, 2 * k): how often each class stood before and behind it. ``now`` is the class that it is taken out of first, -1
    for none. Only its own row and column of ``both`` change by that.
    """
    k = len(both)
    out = np.empty((len(near), k - 1))
    fb = _xlogx(both)
    left, right = both.sum(1), both.sum(0)

    def rise(kept: np.ndarray, f: np.ndarray, more: np.ndarray) -> np.ndarray:
        return _xlogx(kept + more) - f

    for i in range(0, len(near), 512):
        before, behind, own = near[i : i + 512, :k], near[i : i + 512, k:], now[i : i + 512]
        gain = rise(both, fb, before[:, :, None]).sum(1) + rise(both.T, fb.T, behind[:, :, None]).sum(1)
        n, m = behind.sum(1)[:, None], before.sum(1)[:, None]
        gain -= rise(left, _xlogx(left), n) + rise(right, _xlogx(right), m)
        at = np.flatnonzero(own >= 0)
        if len(at):
            a = own[at]
            into, out_of = np.maximum(both[:, a].T - before[at], 0), np.maximum(both[a] - behind[at], 0)
            x, y = np.maximum(left[a] - n[at, 0], 0), np.maximum(right[a] - m[at, 0], 0)
            gain[at, a] = (fb[:, a].T - _xlogx(into)).sum(1) + (fb[a] - _xlogx(out_of)).sum(1) - (_xlogx(left[a]) - _xlogx(x)) - (_xlogx(right[a]) - _xlogx(y))
        out[i : i + 512] = gain[:, : k - 1]
    return out


def choose(near: np.ndarray, now: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The class that each word belongs to; it stays where no other is better, and the first of equal ones has it."""
    gain = gains(near, now, both)
    best = gain.argmax(1)
    at = np.arange(len(now))
    stays = (now >= 0) & (gain[at, now] >= gain[at, best] - 1e-9)
    return np.where(stays, now, best)


def _moved(encoded: DataFrame, cls, n: int, k: int, part: int, parts: int, both: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and new classes of the words ``part``, ``part`` + ``parts``, … below ``n`` that change their class by their neighbours among numbers below ``upto`` and END, and what that changes in ``both``.

    Tasks send packed counts of (word, side and class), dealt by ranges of words and, if tasks are many, summed in two steps.
    """
    fan = -(-len(encoded.inputFiles()) // FAN)

    def packed(codes: np.ndarray, counts: np.ndarray, s: int) -> pa.RecordBatch:
        cuts = np.searchsorted(codes, np.arange(0, -(-n // parts) + RANGE, RANGE) * 2 * k)
        rows = [(p, s, codes[a:b].astype(np.uint32).tobytes(), counts[a:b].astype(np.int64 if counts.max(initial=0) >> 32 else np.uint32).tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["p", "s", "codes", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = cls.value.copy()
        kind[upto:-2] = -1  # all but the clustered words and END
        part_id = 0

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal part_id
            for b in batches:
                if len(b):
                    part_id = b.column(1)[0].as_py()
                yield b

        for seq in _stretches(seen(), len(kind) - 2):
            c = kind[seq]
            own = seq[1:-1]
            mine = (own < n) & (own % parts == part)
            place = own[mine].astype(np.int64) // parts * 2 * k
            a, b = c[:-2][mine], c[2:][mine]
            codes, counts = np.unique(np.concatenate([(place + a)[a >= 0], (place + k + b)[b >= 0]]), return_counts=True)
            yield packed(codes, counts, part_id % fan)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        now, total = -1, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["p"] != now:
                    if total is not None:
                        yield now, total
                    now, total = r["p"], np.zeros(RANGE * 2 * k, np.int64)
                codes = np.frombuffer(r["codes"], np.uint32).astype(np.int64) - now * RANGE * 2 * k
                total[codes] += np.frombuffer(r["counts"], np.uint32 if len(r["counts"]) == len(r["codes"]) else np.int64)  # codes are distinct
        if total is not None:
            yield now, total

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, total in totals(batches):
            at = np.flatnonzero(total)
            yield packed(at + p * RANGE * 2 * k, total[at], 0)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = cls.value
        for p, total in totals(batches):
            near = total.reshape(RANGE, 2 * k)
            seen = np.flatnonzero(near.any(1))
            word = (seen + p * RANGE) * parts + part
            old, near = kind[word], near[seen]
            new = choose(near.astype(np.float64), old, both)
            changed = new != old
            delta = np.zeros((k, k), np.int64)
            for to, sign in ((new, 1), (old, -1)):
                of = np.flatnonzero(changed & (to >= 0))
                np.add.at(delta.T, to[of], sign * near[of, :k])
                np.add.at(delta, to[of], sign * near[of, k:])
            at = np.flatnonzero(delta)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word[changed], -1 - at)), pa.array(np.append(new[changed], delta.ravel()[at]))], ["word", "class"])

    sent = encoded.select("ids", F.spark_partition_id().alias("part")).mapInArrow(send, COUNTS)
    ranges = max(1, -(-n // parts // RANGE))
    if fan > 1:
        sent = sent.repartition(ranges * fan, "p", "s").sortWithinPartitions("p", "s").mapInArrow(again, COUNTS)
    rows = sent.repartition(ranges, "p").sortWithinPartitions("p").mapInArrow(decide, "word bigint, class bigint").toArrow()  # head words, and k * k for each range, at most
    word, value = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    delta = np.zeros(k * k)
    np.add.at(delta, -1 - word[word < 0], value[word < 0])
    return word[word >= 0], value[word >= 0], delta.reshape(k, k)


def cluster(encoded: DataFrame, counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the dictionary's words and of END and words beyond it (-1), as an array of numbers to classes, and the class bigram counts.

    ``counts`` are the words' counts in order of number. Every word below ``clustered`` is exchanged; others are put beside them once.
    """
    n, k = len(counts), s.classes + 1
    end = n
    spread = encoded.sparkSession.sparkContext.broadcast
    upto, core = min(s.clustered, n), min(s.core, s.clustered, n)
    kind = np.full(n + 2, -1, np.int64)
    kind[:core], kind[end] = np.arange(core), core
    of = exchange(_pair_counts(encoded, spread(kind), core + 1, end), s.classes, s.rounds)
    cls = np.full(n + 2, -1, np.int64)
    cls[:core], cls[end] = of[:core], k - 1
    both = _pair_counts(encoded, spread(cls), k, end)
    parts = 3
    for _ in range(s.sweeps if upto > core else 0):
        moved = 0.0
        for part in range(parts):
            word, new, delta = _moved(encoded, spread(cls), upto, k, part, parts, both, upto)
            moved += counts[word].sum()
            cls[word] = new
            both = np.maximum(both + delta, 0)  # but for neighbours that moved together, which the count below sets right
        both = _pair_counts(encoded, spread(cls), k, end)
        if moved < s.still * counts[:upto].sum():
            break
    if upto < n:
        word, new, _ = _moved(encoded, spread(cls), n, k, 0, 1, both, upto)
        rest = word >= upto
        cls[word[rest]] = new[rest]
    return cls, both


def _tails(encoded: DataFrame, cls, k: int, upto: int) -> DataFrame:
    """Every token beyond the dictionary: row, held_out, word, at (its place in the text, from 0), before and behind: the classes of its neighbours below ``upto`` and END, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = cls.value.copy()
        kind[upto:-2] = -1
        for batch in batches:
            ids, begin = _numbers(batch.column(2))
            tail, at = batch.column(3), batch.column(4).flatten().to_numpy()
            owner = np.repeat(np.arange(len(batch)), np.diff(tail.offsets.to_numpy()))
            place = begin[owner] + at
            near = np.append(kind[ids], k - 1)  # the END before a text is that of the one before it, at first the last
            cols = [batch.column(c).take(pa.array(owner)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, tail.flatten(), pa.array(at), *(pa.array(near[x].astype(np.int32)) for x in (place - 1, place + 1))], ["row", "held_out", "word", "at", "before", "behind"])

    rows = encoded.where(F.size("tail") > 0).select("row", "held_out", "ids", "tail", "at")
    return rows.mapInArrow(run, "row bigint, held_out boolean, word binary, at int, before int, behind int")


def _tail_classes(tails: DataFrame, k: int, both: np.ndarray) -> DataFrame:
    """(word, c, class) of the words beyond the dictionary that were seen twice or more and stood beside a clustered one, by the same gain."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros((len(batch), 2 * k))
            near = batch.column(2)
            row = np.repeat(np.arange(len(batch)), np.diff(near.offsets.to_numpy()))
            flat = near.flatten()
            total[row, flat.field("code").to_numpy()] = flat.field("n").to_numpy()
            best = choose(total, np.full(len(batch), -1), both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32))], ["word", "c", "class"])

    code = F.explode(F.array(F.when(F.col("before") >= 0, F.col("before")), F.when(F.col("behind") >= 0, F.col("behind") + k)))
    beside = tails.where("c > 1 and not held_out").select("word", "c", code.alias("code")).where("code is not null").groupBy("word", "c", "code").agg(F.count("*").alias("n"))
    near = beside.groupBy("word", "c").agg(F.collect_list(F.struct("code", "n")).alias("near"))  # 2 * k at most
    return near.mapInArrow(put, "word binary, c bigint, class int")


def score_documents(docs: DataFrame, held_out: str, s: Settings = Settings()) -> DataFrame:
    """``docs`` (doc_id, text and a boolean column ``held_out``) scored by a model of the rows that aren't held out.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (additive unigrams), score (class bigrams; log10), perplexity. A
    null text is empty and has its END alone; a null ``held_out`` counts as held out. Repeated rows count each; without any
    training row every word is unseen. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    training = rows.where("not held_out")
    vocab = save(word_counts(training), "vocabulary")
    short = (F.octet_length("word") <= s.longest) & (F.col("c") > 1) & (F.col("word") != F.lit(END))
    head = vocab.where(short).orderBy(F.desc("c"), "word").limit(s.head)
    got = head.toArrow()  # bounded by the settings
    words = got.column(0).to_pylist()
    counts = got.column(1).to_numpy().astype(np.float64)
    order = np.lexsort((np.arange(len(words)), -counts))
    words, counts = [words[i] for i in order], counts[order]
    whole = vocab.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))).first()
    total, types, ends = (int(x or 0) for x in whole)
    base = total + 0.5 * (types + 1)
    n, k = len(words), s.classes + 1  # with END
    spread = spark.sparkContext.broadcast
    index = spread({w: i for i, w in enumerate(words)})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        names = ["row", "doc_id", "held_out", "ids", "tail", "at"]
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                texts = [tokens(t) for t in part.column(3).to_pylist()]
                begin = np.cumsum([0, *map(len, texts)])
                flat = list(chain.from_iterable(texts))
                ids = np.fromiter(map(own.get, flat, repeat(n + 1)), np.uint32, len(flat))
                tail = np.flatnonzero(ids > n)
                of = np.searchsorted(begin, tail, side="right") - 1
                off = pa.array(np.searchsorted(of, np.arange(len(part) + 1)).astype(np.int32))
                words = pa.array([flat[j] for j in tail.tolist()], pa.binary())
                places = pa.array((tail - begin[of]).astype(np.int32))
                packed = _packed(np.insert(ids, begin[1:], np.uint32(n)), begin[:-1] + np.arange(len(part)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], packed, pa.ListArray.from_arrays(off, words), pa.ListArray.from_arrays(off, places)], names)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    encoded = save(numbered.mapInArrow(number, f"row bigint, doc_id {id_type}, held_out boolean, ids binary, tail array<binary>, at array<int>"), "encoded")
    learnt = encoded.where("not held_out")
    kinds, both = cluster(learnt, counts, s)
    tails = save(_tails(encoded, spread(kinds), k, min(s.clustered, n)).join(vocab.hint("merge"), "word", "left"), "tails")
    tail_classes = save(_tail_classes(tails, k, both), "tail_classes")
    cls = np.where(kinds[:n] >= 0, kinds[:n], k)
    rare, k = k, k + 1  # class k - 1 is END, class k the rare one
    mass = np.bincount(cls, counts, minlength=k)[:k].astype(np.float64)
    for r in tail_classes.groupBy("class").agg(F.sum("c").alias("c")).collect():  # classes at most
        mass[r["class"]] += r["c"]
    mass[rare - 1] = ends
    in_rare = cls == rare
    # The rare class holds words seen once, and words that never stood beside a clustered one.
    mass[rare] = total - mass[: rare].sum()
    once = vocab.where("c = 1").count() or 0.5
    unseen = once / (mass[rare] + once)
    emit = np.log10(counts / np.maximum(mass[cls], 1)) + np.where(in_rare, np.log10(1 - unseen) if unseen < 1 else 0.0, 0.0)
    plain = np.log10((counts + 0.5) / base)
    end_base = float(np.log10((ends + 0.5) / base))
    # By number: words, END and words beyond the dictionary.
    table = spread((np.concatenate([cls, [rare - 1, rare]]), np.append(emit, [0.0, 0.0]), np.append(plain, [0.0, 0.0])))
    small = np.uint8 if k < 256 else np.uint16
    first = f"row bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, n_head bigint, head_base double, head_emit double"

    masses = F.array(*(F.lit(float(max(x, 1))) for x in mass))
    known = tails.select("row", "word", "at", "c").join(tail_classes.select("word", "class").hint("merge"), "word", "left").withColumn("known", F.col("c").isNotNull())
    in_tail = F.log10(F.col("c") / F.get(masses, F.coalesce("class", F.lit(rare)))) + F.when(F.col("class").isNull(), F.lit(float(np.log10(max(1 - unseen, 1e-12))))).otherwise(F.lit(0.0))
    each = F.when(F.col("known"), in_tail).otherwise(F.lit(float(np.log10(unseen))))
    summed = known.groupBy("row").agg(
        F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(base))).alias("tail_base"),
        F.sum(each).alias("tail_emit"),
        F.count_if("known").alias("tail_known"),
        F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "at"))).alias("put"),
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the words of the dictionary, and the classes of each row's tokens, now that its other words have theirs."""
        cls, emit, plain = table.value
        names = ["row", "doc_id", "held_out", "n_tokens", "n_head", "head_base", "head_emit", "tail_base", "tail_emit", "tail_known", "classes"]
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                ids, begin = _numbers(part.column(3))
                c = cls[ids]
                put = part.column(4)
                size = pc.fill_null(pc.list_value_length(put), 0).to_numpy()
                if size.any():
                    flat = put.flatten()
                    c[np.repeat(begin, size) + flat.field("at").to_numpy()] = flat.field("class").to_numpy()
                sums = [pa.array(np.add.reduceat(x, begin)) for x in ((ids < n).astype(np.int64), plain[ids], emit[ids])]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(np.append(begin, len(ids)))), *sums, *part.columns[5:], _packed(c.astype(small), begin)], names)

    whole = encoded.drop("tail", "at").join(summed.hint("merge"), "row", "left").select("row", "doc_id", "held_out", "ids", "put", "tail_base", "tail_emit", "tail_known")
    scored = save(whole.mapInArrow(placed, f"{first}, tail_base double, tail_emit double, tail_known bigint, classes binary"), "scored")

    def steps(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The code of each token's class after that of the token before it, and where texts begin."""
        c, begin = _numbers(column, small)
        c = c.astype(np.int64)
        return np.append(rare - 1, c[:-1]) * k + c, begin  # a text begins after the END of the one before it

    def follows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(k * k, np.int64)
        for batch in batches:
            if len(batch):
                got += np.bincount(steps(batch.column(0))[0], minlength=k * k)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], ["code", "n"])

    seen = scored.where("not held_out").select("classes").mapInArrow(follows, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # k * k at most
    follow = np.zeros(k * k)
    follow[seen.column(0).to_numpy()] = seen.column(1).to_numpy()
    follow = follow.reshape(k, k)
    share = (mass + 0.5) / (mass + 0.5).sum()
    log_follow = np.log10((follow + s.prior * share) / (follow.sum(1, keepdims=True) + s.prior)).ravel()

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, begin = steps(batch.column(batch.num_columns - 1))
            chain = np.add.reduceat(log_follow[code], begin) if len(begin) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(chain)], [*batch.schema.names[:-1], "chain"])

    chained = scored.mapInArrow(transitions, f"{first}, tail_base double, tail_emit double, tail_known bigint, chain double")
    zero = F.lit(0.0)
    out = chained.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + (1 if ends else 0) + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.lit(end_base) + F.coalesce("tail_base", zero)).alias("base_score"), (F.col("head_emit") + F.col("chain") + F.coalesce("tail_emit", zero)).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def lm_digest(docs: DataFrame) -> DataFrame:
    """Query op6: trained on documents whose crc32(doc_id) modulo 5 is not 1; a null id counts as held out."""
    return score_documents(docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("held_out")), "held_out")

"""Language identification by known words first, then backing off to shorter and shorter character n-grams.

A word seen in training scores by its log frequency in each language; a language that never had it gets a floor. An unseen
word scores letter by letter, in each language apart: by the log frequency of the letter after as many of the four letters
before it as that language has seen together with it, and a fixed penalty for each of the four that had to be given up. So
a language that knows longer parts of a word is ahead of one that knows shorter ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.shared import unused

UNKNOWN = "und"
_WORD, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
#: Longest n-gram. Each word stands between two boundary marks.
ORDER = 5
STEP = float(np.log(0.4))
FLOOR = 0.5
MAX_LENGTH = 64  #: longest word that is known as a word; longer ones are scored by all their letters
BLOCK = 50_000  #: letters of unseen words scored at once


def words(text: str) -> list[str]:
    """Maximal runs of letters, in lower case. Numerals such as \u00b2 or \u00bd are no letters."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ((w,) if w.isalpha() else _LETTERS.findall(w))]


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def sample_training(docs: DataFrame, text: str, lang: str, allowed: Column, max_docs: int) -> DataFrame:
    """Labelled rows to fit on: all, or about ``max_docs`` of them, chosen by a hash of the whole row."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.coalesce(allowed, F.lit(False)))
    n = labelled.count()
    if n <= max_docs:
        return labelled
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns), F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * max_docs / n)
    return labelled.where(part)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", allowed: Column | None = None, max_docs: int = 10_000) -> dict:
    """Log frequencies of all words and of all n-grams of the labelled rows that it is fitted on, of which there are about ``max_docs`` at most.

    Counts are summed over tasks; what reaches the driver, and every task, is bounded by that sample. Words over 64
    letters count by their n-grams only. No labelled row gives a model without languages.
    """
    rows = sample_training(docs, text, lang, F.lit(True) if allowed is None else allowed, max_docs).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for one, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(one, Counter()).update(words(t))
            out: list[tuple] = []
            for one, c in by.items():
                g: list[Counter] = [Counter() for _ in range(ORDER)]
                for w, k in c.items():
                    if len(w) <= MAX_LENGTH:
                        out.append((one, 0, w, k))
                    for n in range(1, ORDER + 1):
                        for x in grams(w, n):
                            g[n - 1][x] += k
                out += [(one, n + 1, x, k) for n, c2 in enumerate(g) for x, k in c2.items()]
            for a in range(0, len(out), 50_000):
                cols = list(zip(*out[a : a + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["lang", "n", "item", "c"])

    got = rows.mapInArrow(count, "lang string, n int, item string, c bigint").groupBy("lang", "n", "item").agg(F.sum("c").alias("c")).toArrow()
    langs = sorted(set(got.column("lang").unique().to_pylist()))
    which = pc.index_in(got.column("lang"), pa.array(langs, pa.string())).to_numpy()
    order, value = got.column("n").to_numpy(), got.column("c").to_numpy()
    model: dict = {"langs": langs, "items": [], "logs": []}
    before = np.zeros((0, len(langs)))
    for n in range(ORDER + 1):
        own = np.flatnonzero(order == n)
        coded = pc.dictionary_encode(got.column("item").take(pa.array(own))).combine_chunks()
        items, code = coded.dictionary, coded.indices.to_numpy()
        counts = np.zeros((len(items), len(langs)))
        np.add.at(counts, (code, which[own]), value[own])
        if n == 0:
            mass = counts.sum(0) + FLOOR * (len(items) + 1)
            logs = np.log((counts + FLOOR) / mass)
        else:
            context = counts.sum(0)[None] if n == 1 else before[pc.index_in(pc.utf8_slice_codeunits(items, 0, n - 1), model["items"][-1]).to_numpy()]
            with np.errstate(divide="ignore", invalid="ignore"):
                logs = np.where(counts > 0, np.log(counts / context), np.nan)
            if n == 1:
                model["floor"] = np.log(FLOOR / (counts.sum(0) + FLOOR))
        model["items"].append(items)
        model["logs"].append(logs)
        before = counts
    return model


class Scorer:
    """Scores words by a model; at most ``cap`` unseen words are remembered."""

    def __init__(self, model: dict, cap: int = 200_000):
        self.cap, self.width = cap, len(model["langs"])
        self.known = len(model["items"][0])
        self.base = dict(zip(model["items"][0].to_pylist(), range(self.known), strict=True))
        self.logs = [np.concatenate([x, np.full((1, self.width), np.nan)]) for x in model["logs"]]
        self.grams = [dict(zip(x.to_pylist(), range(len(x)), strict=True)) for x in model["items"][1:]]
        self.floor = model["floor"]
        self.rows = np.concatenate([model["logs"][0], np.zeros((4096, self.width))])
        self.index = dict(self.base)

    def _letters(self, pieces: list[tuple[str, int, int]]) -> np.ndarray:
        """Scores of the letters a to b - 1 of each marked word, one row for each letter."""
        longest = np.concatenate([np.minimum(np.arange(a, b) + 1, ORDER) for _, a, b in pieces])
        score = np.full((len(longest), self.width), np.nan)
        for n in range(ORDER, 0, -1):
            get = self.grams[n - 1].get
            at = np.fromiter((get(w[i - n + 1 : i + 1], -1) if i >= n - 1 else -1 for w, a, b in pieces for i in range(a, b)), np.int64, len(longest))
            found = self.logs[n][at] + STEP * (longest - n)[:, None]
            score = np.where(np.isnan(score), found, score)
        return np.where(np.isnan(score), self.floor + STEP * longest[:, None], score)

    def unseen(self, names: list[str]) -> np.ndarray:
        """Scores of words that training didn't have, by all their letters and the mark behind them."""
        out = np.zeros((len(names), self.width))
        held: list[tuple[int, str, int, int]] = []
        size = 0

        def flush() -> None:
            s = self._letters([h[1:] for h in held])
            begin = np.cumsum([0, *(b - a for _, _, a, b in held[:-1])])
            np.add.at(out, [h[0] for h in held], np.add.reduceat(s, begin))

        for k, name in enumerate(names):
            w = f"<{name}>"
            for a in range(1, len(w), BLOCK):
                held.append((k, w, a, min(a + BLOCK, len(w))))
                size += held[-1][3] - a
                if size >= BLOCK:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the summed scores of its words by language, and the number of words. A text's sum doesn't depend on the texts beside it."""
        parts = [[] if t is None else words(t) for t in texts]
        n = np.array([len(p) for p in parts], np.int64)
        if len(self.index) - self.known > self.cap:
            self.index = dict(self.base)
        total = int(n.sum())
        idx = np.fromiter(map(self.index.get, chain.from_iterable(parts), repeat(-1)), np.int64, total)
        miss = np.flatnonzero(idx < 0)
        if len(miss):
            flat = list(chain.from_iterable(parts))
            names = [flat[i] for i in miss.tolist()]
            new = list(dict.fromkeys(names))
            first = len(self.index)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = self.unseen(new)
            self.index.update(zip(new, range(first, first + len(new)), strict=True))
            idx[miss] = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        out = np.zeros((len(texts), self.width))
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(self.rows[idx], (np.cumsum(n) - n)[some])
        return out, n


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the posterior of the best language under equal priors.

    ``und`` and 0.0 for a null text, one without a letter, and under a model without languages. Ties go to the language first in
    order. Columns named lang_pred or score are replaced; rows and their order stay.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by fit()
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = shared.value["langs"]
        scorer = Scorer(shared.value) if langs else None
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            _, off = W.buffer(column)
            for i, j in W.slices(off, 1_000_000):
                pred, score = [UNKNOWN] * (j - i), np.zeros(j - i)
                if scorer:
                    sums, n = scorer.sums(column.slice(i, j - i).to_pylist())
                    best = sums.argmax(1)
                    share = 1 / np.exp(np.maximum(sums - sums.max(1, keepdims=True), -700)).sum(1)
                    pred = [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)]
                    score = np.where(n > 0, np.minimum(share, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    (own,) = unused(docs.columns, "_text")
    source = docs.select(*(f"`{c}`" for c in names), F.col(f"`{text}`").cast("string").alias(own))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "lang_pred string, score double"])
    return source.mapInArrow(run, schema)


def language_digest(docs: DataFrame) -> DataFrame:
    """Query op2: fitted on documents whose crc32(doc_id) modulo 4 is not 2 (null ids: none), applied to all."""
    bucket = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(docs.select("doc_id", "text", "lang"), allowed=bucket != 2)
    rows = docs.select("doc_id", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).drop("text")

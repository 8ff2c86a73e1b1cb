"""A corpus pipeline of five stages, each an operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.lines import dedup_lines
from quern.llm.neardup import drop_near_duplicates
from quern.llm.packing import pack_documents
from quern.llm.pii import DEMONSTRATION_KEY, pseudonymise, secret_key
from quern.llm.quality import filter_documents
from quern.llm.shared import read_table, save


def _recounted(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names``, with n_chars, if it is one of them, counted from the text as it is now."""
    if "n_chars" in names:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*(F.col(f"`{c}`") for c in names))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the rule ledger keeps; null and empty texts go. Each row is judged by itself, whatever its id; an empty table stays empty."""
    return filter_documents(docs, "v1")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat a kept line go; a document that loses all its lines with ink to this goes as well.

    Null texts, and rows with a null id, stay as they are. Rows that share an id but not the text are documents of their own, rows
    equal in both are one. Other columns stay, whatever their names; an empty table stays empty.
    """
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")))
    done = dedup_lines(docs.select("doc_id", "text", rest.alias("rest"))).where((F.size("removed_lines") == 0) | (F.size("removed_lines") < F.col("n_lines")))
    whole = done.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns))
    return _recounted(whole, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that of least doc_id: five words, similarity 0.8.

    Texts without words and rows with a null id stay. Rows that share an id stay or go together. An empty table stays empty.
    """
    return drop_near_duplicates(docs, k=5, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets format-preserving pseudonyms under spark.quern.pii.key; no document goes, a null text stays null."""
    return _recounted(pseudonymise(docs, key=secret_key(spark, DEMONSTRATION_KEY), spans=None), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids; a null text is empty, each row is packed for itself, and an empty table gives no piece."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("packing", packing)]

#: SQL has no union-find over fuzzy links and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each keeps is a table in the shared folder."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

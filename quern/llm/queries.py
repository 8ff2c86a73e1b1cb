"""Queries over the driver's tables, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.oracles import ORACLES  # noqa: F401
from quern.llm.shared import read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.lines import line_digest

    return line_digest(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.langid import language_digest

    return language_digest(_table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.brown import lm_digest

    return lm_digest(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.bpe import bpe_digest

    return bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ann import neighbour_digest

    return neighbour_digest(_table(spark, sf_dir, "embeddings"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.pii import pii_digest

    return pii_digest(_table(spark, sf_dir, "documents"))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import quality_digest

    return quality_digest(_table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, by bits of the ledger alone."""
    from quern.llm.quality import ablation, ledger

    return ablation(ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each policy keeps, from one ledger."""
    from quern.llm.quality import POLICIES, apply_policy, ledger
    from quern.llm.shared import save

    book = save(ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")), "ledger")
    out = [apply_policy(book, p).groupBy("policy", "kept").agg(F.count("*").alias("n")) for p in POLICIES]
    return reduce(DataFrame.unionByName, out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fuzzy_lines": op1_fuzzy_lines,
    "op2_language": op2_language,
    "op3_pack": op3_pack,
    "op4_reshard": op4_reshard,
    "op5_hyperminhash": op5_hyperminhash,
    "op6_brown": op6_brown,
    "op7_bpe": op7_bpe,
    "op8_additive": op8_additive,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_rule_ledger": op10_rule_ledger,
    "quality_ablation": quality_ablation,
    "quality_policies": quality_policies,
}

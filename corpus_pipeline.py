"""A training-data pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the documents that
it keeps; the last returns what the tokenizer makes of them. Stages are written as Parquet in the shared folder and read
again, so a lost executor repeats part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmesh.llm import bpe, decontaminate, line_dedup, quality, registry, simhash
from voltmesh.llm.scratch import Scratch


_OWN = ("doc_id", "text", "source")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and source, and all other columns in one, so that none of their names can clash with those an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in _OWN]
    return docs.select(*_OWN, F.struct(F.lit(True).alias("_"), *others).alias("others"))


def _documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again; n_chars, where there is one, is that of the text as it is now."""
    out = {c: F.col(c) if c in _OWN else F.col("others").getField(c) for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return df.select(*(v.alias(c) for c, v in out.items()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their source share.

    Null and empty texts fail; null sources are a source of their own; rows equal in doc_id, source and text count once and stay or go together; an empty
    table gives an empty one; other columns stay, whatever their names.
    """
    judged = quality.quality(_packed(docs)).where("kept")
    return _documents(judged.withColumn("text", quality.without_lines(F.col("text"), F.col("removed"))), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each near-equal line only where it stands first; a document of repeated lines only is left empty.

    The first place is that of the smallest doc_id, null ones first; rows equal in doc_id and text lose the same lines; null texts stay null; an empty
    table gives an empty one; other columns stay, whatever their names.
    """
    return _documents(line_dedup.dedup_lines(_packed(docs)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id (null ones last), then the smallest text.

    Null and empty texts are one group, of which one row stays; different texts with one doc_id, or with none, are apart unless near; of rows equal in
    doc_id, text and source any one stays; an empty table gives an empty one; other columns stay, whatever their names.
    """
    marked = simhash.near_duplicates(_packed(docs), group="group_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "text", "source")
    kept = marked.groupBy("group_id").agg(F.min_by(F.struct(*_OWN, "others"), order).alias("kept"))
    return _documents(kept.select("kept.*"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words stand in benchmark passages.

    Null and empty texts have no words and stay; repeated rows stay; empty tables on either side take nothing out; other columns stay, whatever
    their names.
    """
    judged = decontaminate.decontaminate(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _documents(judged.where(~registry.contaminated()), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the decoded text, one row for each row.

    Null and empty texts have no tokens; repeated rows stay; an empty table gives an empty one; other columns are not read.
    """
    return bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: SQL expresses neither the edit join nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs

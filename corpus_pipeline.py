"""A training-corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of documents; the last one
returns the packed pieces. Stages see all that their predecessor kept. Operators get the text and the other columns as
one struct, so columns of documents that are named as an operator's results stay as they are. An empty table stays empty
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, langid, neardup, packing, secrets
from tidewater.llm.common import marked
from tidewater.llm.common import stage as staged
from tidewater.llm.queries import END_OF_PIECE, table, tokenizer


def _apart(docs: DataFrame) -> DataFrame:
    """(row, text): all other columns as one struct."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")


def _whole(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose language can't be told: null and letterless ones, and all if no row has a language to learn from."""
    found = langid.identify(_apart(docs), langid.fit(docs))
    return _whole(found.where(F.col("lang_pred") != langid.UNDETERMINED), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that of the smallest doc_id, and of repeated doc_ids one row. Rows without doc_id all stay."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    classes = neardup.near_duplicates(docs).where("doc_id is not null")
    ids = staged(classes.groupBy(F.col("doc_id").alias("id")).agg(F.max("class_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "ids")
    rows, other = marked(docs, "doc_id", ids.where("id != class_id or n > 1"))
    kept = rows.where(~other).select(*names)
    if not (again := ids.where("id = class_id and n > 1")).isEmpty():  # repeated doc_ids
        rows, several = marked(docs, "doc_id", again)
        kept = kept.unionByName(rows.where(several).select(*names).dropDuplicates(["doc_id"]))
    return kept


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null and empty texts are clean."""
    found = decontaminate.decontaminate(_apart(docs), table(spark, sf_dir, "benchmark"))
    return _whole(found.where("not contaminated"), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and n_chars of texts that changed; null and empty texts stay."""
    done = secrets.redact(secrets.scan_secrets(_apart(docs)))
    if "n_chars" not in docs.columns:
        return _whole(done, docs.columns)
    length = F.when(F.size("found") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row").getField("n_chars"))
    return done.select(*(F.col("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences; a null text is one end id."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), END_OF_PIECE)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secret_scan), ("packing", pack)]
#: Language ID, classes of near duplicates and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = staged(function(spark, docs, sf_dir), name)
    return docs

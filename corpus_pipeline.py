"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet and read again. All but the last return the columns of
``documents``.

A row is judged by its own text, whatever its doc_id. Rows with a null doc_id take part in
every stage and stay where their text is clean and no copy; so do rows that repeat a
doc_id with another text. Of rows with the same doc_id and text one stays (the least by
its other columns that have an order). Among copies the smallest doc_id stays; null ids, and the further
texts of a repeated id, come after all ids below 2 ** 62.

Null and empty texts, and texts without a letter, have no language and go in the first
stage; very long texts are read whole by every stage; a document whose lines are all
copies goes in the line stage; an empty table gives an empty result. Names that start with
``_pipeline_`` and the columns n_lines and n_dropped are the stages' own; other columns of
``documents``, clashing with operators' names or not, pass through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from vertexflow.llm import decontaminate, language, line_dedup, near_dup, packing
from vertexflow.llm.common import broadcast_if_small, keyed_crc32, table
from vertexflow.llm.store import Store

#: Documents whose best language has a lower mean probability are rejected, and so is ``und``.
LEAST_LANGUAGE_SCORE = 0.3
#: A column that tells rows apart within a stage.
ROW = "_pipeline_row"
#: Repeated ids that a broadcast may hold; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000


def _orderable(kind: DataType) -> bool:
    """Whether values of a type have an order; maps have none."""
    inside = [kind.elementType] if isinstance(kind, ArrayType) else [f.dataType for f in kind.fields] if isinstance(kind, StructType) else []
    return not isinstance(kind, MapType | VariantType) and all(map(_orderable, inside))


def _by_text(docs: DataFrame) -> DataFrame:
    """``docs`` with a never-null ROW for each text."""
    return docs.withColumn(ROW, F.xxhash64("text"))


def _by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a never-null ROW for each (doc_id, text): the doc_id, except for null ids and the further texts of a repeated id."""
    text = F.xxhash64("text")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("_pipeline_first"), F.max(text).alias("_pipeline_last")).where("_pipeline_first <> _pipeline_last")
    several = several.select(F.col("doc_id").alias("_pipeline_id"), "_pipeline_first")
    joined = docs.join(broadcast_if_small(several, several.count(), BROADCAST_IDS), F.col("doc_id") == F.col("_pipeline_id"), "left")
    own = F.col("doc_id").isNotNull() & (F.col("_pipeline_first").isNull() | (F.col("_pipeline_first") == text))
    other = F.shiftrightunsigned(F.xxhash64(F.lit("row"), "doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))
    return joined.withColumn(ROW, F.when(own, F.col("doc_id").cast("long")).otherwise(other)).drop("_pipeline_id", "_pipeline_first")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = language.train(docs, F.coalesce(keyed_crc32("doc_id") % 4 != 2, F.lit(False)))
    rows = _by_text(docs)
    kept = language.predict(spark, rows, net, id_col=ROW).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return rows.join(kept.select(ROW).distinct(), ROW, "left_semi").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(spark, _by_row(docs), id_col=ROW)
    return out.where("n_lines > n_dropped").withColumn("n_chars", F.length("text").cast("long")).drop("n_lines", "n_dropped", ROW)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _by_row(docs)
    kept = near_dup.near_duplicates(spark, rows, words=5, percent=80, id_col=ROW).where("kept")
    left = rows.join(kept.select(ROW).distinct(), ROW, "left_semi")
    least = F.struct([c for c in docs.columns if _orderable(docs.schema[c].dataType)])
    return left.groupBy(ROW).agg(F.min_by(F.struct(docs.columns), least).alias("row")).select("row.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _by_text(docs)
    found = decontaminate.contaminated(spark, rows, table(spark, sf_dir, "benchmark"), id_col=ROW).where("contaminated")
    return rows.join(found.select(ROW).distinct(), ROW, "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_dup_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Trained networks, tokenizers and hashed candidates aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    store, docs = Store(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), "stage")
    return docs

"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.llm import bpe_codec, decontamination, jaccard_join, language_id, toxicity
from lakeglass.llm.queries import held_out
from lakeglass.llm.session import delete_folder, ensure_checkpoint_dir, materialise, small_keys, table

TOXIC_SCORE = 0.3


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a 64-bit key of id and text: ids may be null or repeat with other texts."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (with ``_row``) but those whose key is in ``gone``; texts stay where they are."""
    return rows.join(small_keys(gone.select("_row").distinct()), "_row", "left_anti").drop("_row")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity network scores at least ``TOXIC_SCORE``."""
    net = toxicity.learn(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    rows = _keyed(docs)
    return _without(rows, toxicity.score_documents(rows, net, id_col="_row", threshold=TOXIC_SCORE).where("predicted = 1"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter in the text, or nothing to learn from.

    A low score alone rejects nothing, since short clean texts have low scores.
    """
    model = language_id.learn(docs.where(~held_out()))
    rows = _keyed(docs)
    return _without(rows, language_id.identify(rows, model, id_col="_row").where(F.col("lang_pred") == language_id.UNKNOWN))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of near copies; a null id comes last.

    Rows that agree in id and text are one row.  Rows without shingles are no copies
    of each other and are all kept.  Only keys are shuffled: the texts of what goes, or
    occurs more than once, are found by their keys.
    """
    rows = _keyed(docs)
    found = jaccard_join.jaccard_components(rows, id_col="_row").where("n_shingles > 0")
    groups = found.groupBy("_row", "component_id").agg(F.count("*").alias("n"))
    ids = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("at")).distinct()
    members = materialise(groups.join(ids, "_row"))
    first = members.groupBy("component_id").agg(F.min("at").alias("first"), F.count("*").alias("size")).where("size > 1").select("component_id", "first")
    removed = small_keys(members.join(first, "component_id").where("at <> first").select("_row"))
    repeated = small_keys(members.where("n > 1").select("_row").join(removed, "_row", "left_anti"))
    once = rows.join(removed, "_row", "left_anti").join(repeated, "_row", "left_anti")
    return once.unionByName(rows.join(repeated, "_row", "left_semi").dropDuplicates(["_row"])).drop("_row")


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a copy or an edited copy of a benchmark item."""
    rows = _keyed(docs)
    judged = decontamination.contaminated_ids(rows, table(spark, sf_dir, "benchmark"), id_col="_row")
    return _without(rows, judged.where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("language_id", keep_identified),
    ("near_copies", drop_near_copies),
    ("decontamination", remove_leaks),
    ("bpe_encoding", encode),
]

#: No stage but the last two could be put in SQL, so the pipeline is tested against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again.

    The folder of a stage is deleted once the next one is written; the last one stays,
    since the result reads it.
    """
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        folder = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before is not None:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs

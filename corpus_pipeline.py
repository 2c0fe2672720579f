"""Corpus pipeline: five stages over ``documents``, each written and read again by the next.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all rows it is given; all but
the last return the columns of ``documents`` (``n_chars`` follows the text). SQL can't express the
learnt, hashed and sampled stages, so the pipeline is tested against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.linededup import dedup_lines
from radiolake.llm.mixing import mix
from radiolake.llm.pieces import encode
from radiolake.llm.quality import THRESHOLD, fit_on_corpus
from radiolake.llm.shared import stage_table, table
from radiolake.llm.similar import drop_similar

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = fit_on_corpus(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__score", model.score(F.col("text"))).filter(F.col("__score") >= THRESHOLD).select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that an earlier document, or place, has too."""
    cut = F.when(F.col("removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return dedup_lines(docs).withColumn("n_chars", cut).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group: of SimHash fingerprints, with an exact check at a five-word Jaccard similarity of 0.8, and of texts as alike beyond the radius."""
    return drop_similar(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shuffled."""
    return mix(docs).select(*COLUMNS)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their best segmentation and the scores of the N best."""
    return encode(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", cut_repeated_lines),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", segment),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, f"pipeline-{i}")
    return docs

"""A corpus from raw documents to packed token ids, in stages of the operators in plumbgrid.llm.

Each stage works on the rows that the one before it kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgrid.llm import decontaminate, language, mixing, near, packing, queries
from plumbgrid.llm.text import read
from plumbgrid.session import cut, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of an Arrow batch, and where Spark has that bound. By its usual 10,000 rows a batch of whole texts
#: has no bound, and the JVM and the Python worker each hold it more than once.
BATCH_BYTES, BATCH_CONF = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Near duplicates of this stage: shingles of five words, similarity in percent.
SHINGLE, SIMILARITY = 5, 80
END_ID = 2


def in_batches(stage: Stage) -> Stage:
    """The stage with batches of BATCH_BYTES, unless the session has a bound of its own; the session keeps it."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_CONF, None) is None:
            spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear stay: not those without a letter or between two languages.

    Learns from all rows with a language that are not held out.
    """
    model = language.train(docs.where(language.learnable()))
    found = language.predict(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model, keep=["_row"])
    return found.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")).select("_row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-duplicates stays."""
    gone = cut(near.near_duplicates(docs, SHINGLE, SIMILARITY).where(~F.col("kept")).select("doc_id").distinct())
    return near.without(docs, gone)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them, each of them once at least."""
    return mixing.mixed(docs, entropy=queries.MIX_ENTROPY, repeats=queries.MIX_REPEATS, cover=True).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's ids, written packed and described from the files."""
    return packing.encoded(docs, queries.tokenizer_file(), END_ID)


STAGES: list[tuple[str, Stage]] = [(name, in_batches(stage)) for name, stage in (
    ("language ID", identify), ("MinHash near-dedup", deduplicate), ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mix), ("token-ID / binary output", token_ids))]

#: Trained models, searches in a latent space and the tokenizer can not be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""What tasks hold of whole texts at once, and what they give back."""

import corpus_pipeline
import pyarrow as pa
import pytest
from plumbgrid.llm import decontaminate, language, near, text
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
#: A bound, and a row that may pass it.
MOST = corpus_pipeline.BATCH_BYTES + (1 << 20)


@pytest.mark.parametrize("stage, module", [("language ID", language), ("MinHash near-dedup", near),
                                           ("benchmark decontamination", decontaminate)])
def test_batches_of_whole_texts_are_bounded(spark, monkeypatch, stage, module):
    """Six hundred texts of 20 KB, 12 MB in one task, do not come in one batch."""
    docs = spark.range(600).coalesce(1).select(
        F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("some plain words "), F.col("id").cast("string")), 1_000).alias("text"),
        F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(20_000).cast("bigint").alias("n_chars"))

    def bounded(texts, limit=text.SLICE_BYTES, slices=text.slices, most=MOST):
        if texts.nbytes > most:
            raise ValueError(f"a batch of {texts.nbytes} bytes of text")
        return slices(texts, limit)

    monkeypatch.setattr(module, "slices", bounded)
    spark.conf.unset(corpus_pipeline.BATCH_CONF)
    dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).write.format("noop").mode("overwrite").save()


def test_a_bound_of_the_session_stays(spark):
    spark.conf.set(corpus_pipeline.BATCH_CONF, "1000000")
    try:
        corpus_pipeline.in_batches(lambda spark, docs, sf_dir: docs)(spark, spark.range(1), SF)
        assert spark.conf.get(corpus_pipeline.BATCH_CONF) == "1000000"
    finally:
        spark.conf.unset(corpus_pipeline.BATCH_CONF)


def test_a_task_gives_back_at_its_end(monkeypatch):
    class Pool:
        def release_unused(self):
            seen.append("back")

    seen = []
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    for batch in text.giving_back(lambda batches: (x + 1 for x in batches))(iter([1, 2])):
        seen.append(batch)
    assert seen == [2, 3, "back"]

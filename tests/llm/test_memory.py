"""What a stage of the pipeline finds of the heap that earlier steps took."""

import gc

import pytest

import corpus_pipeline


def test_a_stage_gives_back_the_heap_that_earlier_steps_took(spark, sf_dir):
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    taken = spark.sparkContext._gateway.new_array(spark._jvm.long, 250_000_000)
    before = heap.totalMemory()
    del taken
    gc.collect()
    rows = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, sf_dir)
    assert before >= 2_000_000_000 and heap.totalMemory() < before - 500_000_000
    assert rows.columns == docs.columns


def test_every_stage_begins_with_that(monkeypatch, spark):
    class Begun(Exception):
        pass

    def begin(session):
        assert session is spark
        raise Begun

    monkeypatch.setattr(corpus_pipeline, "heaps_trimmed", begin, raising=False)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Begun):
            stage(spark, None, "")

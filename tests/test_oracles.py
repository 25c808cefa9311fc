"""Every query against its SQL, and the contract of the entry module."""

import oracle
import pytest

import __spark_entry__ as entry
from cadencia.plans import streams

QUERIES = {name: f for area in entry.AREAS for name, f in area.SPARK.items()}
ORACLES = {name: text for area in entry.AREAS for name, text in area.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    oracle.check(spark, sf_dir, QUERIES[name], ORACLES[name])


def test_stream_form_of_more_files_than_a_batch_takes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 2)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # a file for each partition
    try:
        oracle.check(spark, sf_dir, QUERIES["stream_form"], ORACLES["stream_form"])
    finally:
        spark.conf.unset(key)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "day", "load", "ctl", "atl", "tsb"] and df.count() == 397


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

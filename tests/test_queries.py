"""Every query of the library against DuckDB."""

from __future__ import annotations

import pytest
from compare import rows_of, sql_rows
from pyspark.sql import functions as F

from emberline.queries import ORACLE_SQL, QUERIES, events


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    names, rows = rows_of(QUERIES[name](spark, sf_dir))
    want_names, want = sql_rows(sf_dir, ORACLE_SQL[name])
    assert names == want_names
    assert rows == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_stream_gives_the_rows_of_the_batch(spark, sf_dir):
    """But for events that the watermark, ten seconds behind, hasn't passed yet."""
    names, stream = rows_of(QUERIES["stream_sequence"](spark, sf_dir))
    same_names, batch = rows_of(QUERIES["seq_two_step"](spark, sf_dir))
    last = events(spark, sf_dir).where("event_type in ('signup', 'purchase')").agg(F.max("ts_mono_ns")).first()[0]
    assert names == same_names
    assert stream == [r for r in batch if r[names.index("ts")] <= last - 10_000_000_000]
    assert len(batch) - len(stream) <= 1


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["rule_id", "key", "first_ts", "ts", "event_ids"]
    assert set(e.oracle_sql()) <= set(e.queries())

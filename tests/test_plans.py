"""Physical-plan checks: pruning and pushdown reach the parquet scan."""
from pyspark.sql import functions as F

from conftest import SF_TINY
from tessera.plans import fixtures as fx


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_scan_reads_only_needed_columns(spark):
    p = _plan(fx.panel_wide(spark, SF_TINY).select("cohort", "quantity"))
    assert "l_shipdate" not in p and "l_comment" not in p


def test_filter_is_pushed_to_scan(spark):
    s = fx.scores(spark, SF_TINY).where(F.col("id") < 100)
    assert "PushedFilters: [IsNotNull(event_id), LessThan(event_id,100)]" in _plan(s)

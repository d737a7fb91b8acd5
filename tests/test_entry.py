"""Driver contract: entry(), query registry and oracle keys."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "hour_bucket" in df.columns


def test_oracles_are_registered_queries():
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs) and len(qs) >= 100


def test_some_queries_match_schema_on_smoke_data(spark):
    qs = E.queries()
    for name in ("hourly_metrics", "best_adapter", "label_emotion", "linear_feet", "html_to_text"):
        df = qs[name](spark, E.SMOKE_DIR)
        assert df.count() >= 0 and len(df.columns) > 0


def test_every_registered_query_runs_on_smoke_data(spark):
    """All queries build and execute over the sf0.001 driver tables."""
    failures = {}
    for name, build in E.queries().items():
        try:
            build(spark, E.SMOKE_DIR).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - collect every failure for the report
            failures[name] = str(e)[:200]
    assert not failures, failures

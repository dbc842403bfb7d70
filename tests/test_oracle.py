"""Registered queries against their DuckDB SQL on the smallest tables, and that all of them are well formed."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracefold import registry

SF = "/root/testdata/sf0.001"
CHECKED = "i02_loss_overflow_windows a02_align_apply r01_task_state_segments r02_exec_slices r04_hold_edges r05_wait_edges m01_cpu_utilization m06_deadline_miss x04_priority_inversion b03_timeline_buckets q01_event_page_forward j02_wait_chains p05_task l03_lineage_status e01_dependency_edges k05_required_refs t03_tfidf_search t19_current_version s01_scan_trace i04_truncation_windows e03_seed_resolution v05_resource_semantics m13_metric_bucket_series t05_case_similarity t20_scoring_eligibility t16_collector_reconcile j10_nearest_event a04_event_order c01_systrace_to_events s06_scan_vcd w05_stream_bucket_counts q05_resource_drilldown s01_scan_range s12_read_counters r06_long_trace w01_byte_feed w04_stream_state_segments".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_registry():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Registered queries against their SQL; ``ALL_QUERIES=1`` runs every one of them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from strandline.plans.views import TABLES

SF = "/root/testdata/sf0.001"
QUICK = ["JN1_interval_overlap", "WIN4_merge_overlapping", "AGG1_file_qc", "AGG13_genome_coverage", "WIN12_iqr_outliers", "AGG4_mod_site_counts_combined", "AGG26_gene_tags",
         "AGG32_validated_fusions", "AGG41_cnv_events", "AGG23_vcf_annotations", "AGG48_calibrate_scores", "STM4_stream_methylation", "SRC1_read_alignments", "SEG1_change_points", "SNK8_export_frames", "AGG36_fusion_funnel", "SRC12_read_scores"]
NAMES = [n for n in entry_point.queries() if not n.startswith("op") and n != "pipeline"] if os.environ.get("ALL_QUERIES") else QUICK


def norm(v):
    if v is None or isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
        return None if math.isnan(float(v)) else float(f"{float(v):.9g}")
    return str(v)


def table(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, SF)
    got = table(df.columns, df.collect())
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    assert got == table([d[0] for d in cur.description], cur.fetchall())


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    core = {n for n in entry_point.queries() if not n.startswith("op") and n != "pipeline"}
    assert core <= set(entry_point.oracle_sql())


def test_entry_has_a_stable_schema(spark):
    found = entry_point.entry(spark)
    assert found.columns[:2] == ["sample_id", "chrom"] and found.count() > 0

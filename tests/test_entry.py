"""The driver's contract on the smallest tables, and the plans of operators that must stay in the JVM."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("files", "chunks", "toc_entries", "enrichment", "documents", "lexicon", "pack_specs")


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.core.SQL))
def test_query_equals_sql(spark, data, sql, name):
    frame = entry.queries()[name](spark, data)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    want = sql.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted((tuple(plain(v) for v in r) for r in want), key=str)


@pytest.mark.parametrize("name", ["eval_p1", "eval_p2", "quality_by_source", "clean_md", "md_sections", "merge_short", "toc_enrich_fallback", "near_dup_pairs", "annotation_range_join"])
def test_plans_stay_in_the_jvm(spark, data, name):
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"))

"""Every own query with SQL against DuckDB on the smallest tables; the others for their invariants."""

import pytest

from lumispan.plans.oracle import oracle_sql
from lumispan.plans.queries import queries

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert differences(queries()[name](spark, SF), SQL[name], SF, con) == []


def test_generated_keeps_roots_and_edges(spark):
    from pyspark.sql import functions as F

    from lumispan.operators.generate import generate
    from lumispan.operators.model import annotated, start_table, topology_edges, train
    from lumispan.plans.queries import CONFIG, spans

    s = spans(spark, SF)
    a = annotated(s)
    out = generate(train(s, CONFIG)).cache()
    roots = out.where("depth = 0").groupBy("bucket", "trace_type", "feature", "child_count").agg(F.count("*").alias("n"))
    assert roots.exceptAll(start_table(a)).isEmpty() and start_table(a).exceptAll(roots).isEmpty()
    up = out.select(F.col("span_id").alias("parent_span_id"), F.col("feature").alias("parent"))
    edges = out.join(up, "parent_span_id").select("bucket", "trace_type", "parent", "feature").distinct()
    known = topology_edges(a).select("bucket", "trace_type", "parent", "feature").distinct()
    assert edges.exceptAll(known).isEmpty()
    largest = out.groupBy("bucket", "trace_id").count().groupBy("bucket").agg(F.max("count").alias("m"))
    assert largest.join(a.groupBy("bucket", "trace_id").count().groupBy("bucket").agg(F.max("count").alias("x")), "bucket").where("m > x").isEmpty()
    again = generate(train(s.repartition(7), CONFIG))
    assert out.exceptAll(again).isEmpty()


def test_template_mode_returns_the_trees(spark):
    from lumispan.plans.queries import spans

    assert queries()["generated_templates"](spark, SF).count() == spans(spark, SF).count()


def test_sifter_and_sizes(spark):
    kept = queries()["sifter_sample"](spark, SF)
    assert kept.count() == kept.select("trace_id").distinct().count() > 0
    size = queries()["gzip_size"](spark, SF).first()
    assert size["rows"] == 1000 and 0 < size["gz_bytes"] < size["raw_bytes"]
    assert queries()["arrow_size"](spark, SF).first()["arrow_bytes"] > 0


def test_micro_rank_is_a_ranking(spark):
    rows = queries()["micro_rank"](spark, SF).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(a["score"] >= b["score"] - 1e-9 for a, b in zip(rows, rows[1:], strict=False))

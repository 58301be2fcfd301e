"""Exact dedup and source mixing against SQL and against plain Python on awkward rows."""

import collections

import pytest
from oracle import compare
from pyspark.sql import functions as F

from quillframe.llm import exact_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, rid int, head string"


@pytest.mark.parametrize("module", [exact_dedup, mixing])
def test_against_sql(spark, sf, con, module):
    compare(module.opquery(spark, sf), con, module.SQL)


def awkward(spark):
    long = "wörd " * 40_000
    rows = [
        (1, "same", "en", "a", 4, "x", 1, "h"), (2, "same", "en", "b", 4, "x", 1, "h"), (2, "same", "en", "b", 4, "x", 1, "h"),
        (3, "", "en", "a", 0, None, None, None), (4, "", None, None, 0, None, None, None), (5, None, "en", "a", None, None, None, None),
        (6, None, "en", None, None, None, None, None), (None, "same", "en", "a", 4, None, None, None), (None, "alone", None, "a", 5, None, None, None),
        (7, long, "de", "b", len(long), None, None, None), (8, long, "de", "a", len(long), None, None, None), (9, long + "x", "de", "a", len(long) + 1, None, None, None),
        (10, "y" * 64, "en", "a", 64, None, None, None), (11, "y" * 64, "en", "a", 64, None, None, None), (12, "y" * 65, "en", "a", 65, None, None, None),
        (13, "y" * 320, "en", "a", 320, None, None, None), (14, "y" * 320, "en", "a", 320, None, None, None), (15, "y" * 321, "en", "c", 321, None, None, None),
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_exact_groups_awkward(spark):
    rows, df = awkward(spark)
    by = collections.defaultdict(list)
    for r in rows:
        if r[1] is not None:
            by[r[1]].append(r[0])
    want = sorted((repr(i), min(x for x in ids if x is not None), len(ids)) for ids in by.values() if len(ids) > 1 for i in ids)
    assert sorted((repr(r.doc_id), r.group_id, r.copies) for r in exact_dedup.exact_groups(df).collect()) == want


def test_exact_drop_awkward(spark):
    rows, df = awkward(spark)
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns
    first = {}
    for r in rows:
        if r[1] is not None:
            first[r[1]] = min(first.get(r[1], r), r, key=lambda x: (x[0] is None, x[0] or 0))
    want = [*first.values(), *(r for r in rows if r[1] is None)]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_exact_beyond_the_broadcast_limit(spark, sf, con, monkeypatch):
    """The table of bits sends only candidates' texts through the join, and gives the same."""
    monkeypatch.setattr(exact_dedup.common, "BROADCAST_BYTES", 0)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    compare(exact_dedup.exact_groups(docs), con, exact_dedup.SQL)
    test_exact_drop_awkward(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exact_dedup._with_groups(docs, exact_dedup.FIRST_BYTES, "grp")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    alone, joined = plan.split("SortMergeJoin")
    assert "BroadcastHashJoin" in alone and "BroadcastHashJoin" in joined  # the bits are looked up on either side
    seen = exact_dedup._with_groups(docs, exact_dedup.FIRST_BYTES, "grp").filter("grp is not null").count()
    assert seen < docs.count() / 2


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(df).count() == 0
    assert exact_dedup.drop_exact_copies(df).count() == 0
    assert mixing.mix(df).count() == 0


def test_mix_awkward_keeps_columns_and_budget(spark):
    _, df = awkward(spark)
    out = mixing.mix(df, targets={"a": 3.0, "b": 1.0}, epoch="pass")
    assert out.columns == [*df.columns, "pass"]
    sizes = dict(df.groupBy("source").agg(F.sum(mixing.tokens_of(F.col("text")))).collect())
    got = dict(out.groupBy("source").agg(F.sum(mixing.tokens_of(F.col("text")))).collect())
    total = sum(sizes.values())
    assert got["a"] <= total * 0.75 + 1 and got.get("b", 0) <= total * 0.25 + 1 and not got.get("c")
    passes = collections.Counter((r.source, r["pass"]) for r in out.collect())
    whole = int(total * 0.75 // sizes["a"])
    assert all(passes["a", e] == df.filter("source = 'a'").count() for e in range(whole))


def test_mix_favours_weight(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "clean text here").otherwise("jun*** ##k$$").alias("text"), F.lit("s").alias("source"))
    out = mixing.mix(df, targets={"s": 1.0}, ratio=0.4).groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    n = {r.odd: r["count"] for r in out}
    assert n[0] > 5 * n.get(1, 0)

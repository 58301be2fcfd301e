"""Each stage of the pipeline against brute force on its own input, and the rows of run()."""

import collections
import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_dedup import brute as near_brute
from test_near_dedup import shingles
from test_packing_warc import brute as pack_brute
from test_packing_warc import check_cover

import corpus_pipeline
from quillframe import cluster
from quillframe.llm import curve_packing, mixing, near_dedup, rule_ensemble
from quillframe.llm.common import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, small):
    """[(name, input rows, output)] of a whole run."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = settle(stage(spark, docs, small), "test")
        out.append((name, docs.collect(), after))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["quality classifier", "exact dedup", "near dedup", "source mixing", "packing"]
    assert all(s[2].columns == COLUMNS for s in stages[:-1])


def test_quality_stage(spark, small, stages):
    _, before, after = stages[0]
    model = rule_ensemble.train(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    stats = rule_ensemble.with_statistics(spark.createDataFrame(before), ["doc_id"], "s").select("doc_id", "s.*").toPandas()
    p = model.score(stats[list(rule_ensemble.STATISTICS)].to_numpy(float))
    assert {r.doc_id for r in after.collect()} == set(stats["doc_id"][p >= rule_ensemble.THRESHOLD])


def test_exact_stage(stages):
    _, before, after = stages[1]
    first = {}
    for r in before:
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(first.values())


def test_near_stage(stages):
    _, before, after = stages[2]
    pairs, ids, root = near_brute([(r.doc_id, r.text) for r in before]), [r.doc_id for r in before], list(range(len(before)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, ratio in pairs:
        if ratio <= near_dedup.COPY_RATIO:
            root[find(a)] = find(b)
    sizes, first = {}, {}
    for i, r in enumerate(before):
        g = find(i)
        first[g], sizes[g] = min(first.get(g, r.doc_id), r.doc_id), max(sizes.get(g, 0), len(shingles(r.text)))
    inside = {find(a) for a, b, _ in pairs if sizes[find(a)] < sizes[find(b)]}
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for g, d in first.items() if g not in inside)
    assert len(ids) > len(first)


def test_mixing_stage(stages):
    _, before, after = stages[3]
    rows = collections.defaultdict(list)
    for r in before:
        tokens = -(-len(r.text.encode()) // mixing.BYTES_PER_TOKEN)
        marks = sum(c in mixing.MARKS for c in r.text)
        weight = max(0.05, 1 - 4 * marks / len(r.text)) if r.text else 1.0
        u = (int(md5(f"{r.doc_id}:{mixing.SEED}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rows[r.source].append((-math.log(u) / weight, r.doc_id, tokens))
    size = {s: sum(x[2] for x in v) for s, v in rows.items()}
    raw = {s: float(n) ** mixing.ALPHA for s, n in size.items()}
    want = collections.Counter()
    for s, v in rows.items():
        budget = round(sum(size.values()) * raw[s] / sum(raw.values()))
        run, rest = 0, budget - budget // size[s] * size[s]
        for _, d, n in sorted(v):
            run += n
            want[d] += budget // size[s] + (run <= rest)
    assert collections.Counter(r.doc_id for r in after.collect()) == +want


def test_packing_stage(stages):
    _, before, after = stages[4]
    got = [tuple(r) for r in after.collect()]
    copy = collections.Counter()
    rows = []
    for r in sorted(before, key=lambda r: r.doc_id):
        rows.append((r.doc_id, r.text, copy[r.doc_id]))
        copy[r.doc_id] += 1
    want = pack_brute([r[:2] for r in rows], curve_packing.CAPACITY, [r[2] for r in rows])
    want = [(p, at, d, a, b) for p, at, d, a, b in want]
    got, numbers = [(p, at, d, a, b) for p, at, d, _, a, b in got], [(p, d, c) for p, _, d, c, _, _ in got]
    assert len(set(got) & set(want)) > 0.9 * len(set(want))
    assert sum(copy.values()) > len(copy)
    assert collections.Counter(d for d, c in {(d, c) for _, d, c in numbers}) == copy
    tokens = sum(b - a for *_, a, b in got)
    if tokens > 4 * curve_packing.CAPACITY:  # a document and its repeat don't meet in a pack
        met = collections.Counter((p, d) for p, d, c in set(numbers))
        assert sum(n > 1 for n in met.values()) <= 1
    words = collections.Counter()
    for r in before:
        words[r.doc_id] += len(r.text.split())
    spans = collections.Counter()
    for _, _, d, a, b in got:
        spans[d] += b - a
    assert spans == words
    once = {r.doc_id for r in before}
    if len(once) == len(before):
        check_cover(got, dict(words), curve_packing.CAPACITY)
    assert np.max([p for p, *_ in got]) == (sum(words.values()) - 1) // curve_packing.CAPACITY


def test_run_gives_the_last_stage(spark, small, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_run_with_awkward_rows_and_without_rows(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("grp", F.lit(1)).withColumn("Key", F.lit("k")).withColumn("h", F.lit(2.0))
    extra = [(None, None, None, None, None), (None, "", None, None, 0), (1, None, "en", "web", None), (10**6, "word " * 200_000, "en", None, 1), (10**6, "word " * 200_000, "en", None, 1), (10**6 + 1, "", "de", "x", 0)]
    rows = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as grp", "'k' as Key", "cast(2.0 as double) as h")
    docs.unionByName(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    before = len(cluster._MADE)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(cluster._MADE) <= before + 1
    spans = collections.defaultdict(list)
    for r in out:
        spans[r.pack_id].append((r.pack_start, r.pack_start + r.doc_end - r.doc_start))
    for p, x in spans.items():
        x = sorted(x)
        assert x[0][0] == 0 and all(a[1] == b[0] for a, b in zip(x, x[1:])) and (x[-1][1] == curve_packing.CAPACITY or p == max(spans))
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)

"""Both quality models: held-out accuracy, agreement of column rules with NumPy, and awkward rows."""

import numpy as np
import pytest

from quillframe.llm import hashed_classifier, rule_ensemble

SCHEMA = "doc_id long, text string, s_ int, p_quality string, t_ string, quality int"


def awkward(spark):
    rows = [(1, None), (2, ""), (None, "The plain text of a document. It has lines.\nAnd more."), (4, "x" * 300_000), (4, "x" * 300_000), (5, " "), (6, "aa " * 50_000)]
    return spark.createDataFrame([(d, t, 1, "p", "t", 2) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels.filter("doc_id % 3 != 0"), labels.filter("doc_id % 3 = 0")


@pytest.mark.parametrize("module", [rule_ensemble, hashed_classifier])
def test_held_out_and_awkward(spark, tables, module):
    docs, seen, unseen = tables
    model = module.train(docs, seen)
    out = module.score(docs.join(unseen, "doc_id"), model, "p").select("quality", "p").toPandas()
    bad, good = out[out.quality == 0].p, out[out.quality == 1].p
    assert (bad < 0.5).mean() >= 0.85 and (good >= 0.5).mean() >= 0.97
    df = awkward(spark)
    scored = module.score(df, model, "p")
    assert scored.columns == [*df.columns, "p"]
    found = scored.collect()
    assert len(found) == 7 and all(0 <= r.p <= 1 for r in found)
    assert len({r.p for r in found if r.doc_id == 4}) == 1 and found[0].p == found[1].p


@pytest.mark.parametrize("module", [rule_ensemble, hashed_classifier])
def test_without_labels_and_without_rows(spark, module):
    df = awkward(spark)
    none = spark.createDataFrame([(1, 1), (1, None), (None, 0), (99, 0)], "doc_id long, quality int")
    kept = module.keep(df, none)
    assert kept.columns == df.columns and kept.count() == 7
    empty = spark.createDataFrame([], SCHEMA)
    assert module.keep(empty, none).count() == 0


def test_compiled_rules_equal_numpy(spark, tables):
    docs, seen, _ = tables
    model = rule_ensemble.train(docs, seen)
    assert 0 < len(model.rules) < 150
    stats = rule_ensemble.with_statistics(docs, ["doc_id"], "s")
    rows = stats.select("s.*", model.probability("s").alias("p")).toPandas()
    want = model.score(rows[list(rule_ensemble.STATISTICS)].to_numpy(float))
    np.testing.assert_allclose(rows["p"].to_numpy(), want, rtol=1e-9)


def test_statistics_of_a_small_text(spark):
    df = spark.createDataFrame([(1, "Ab ab ab C!\nAb 12."), (2, None)], "doc_id long, text string")
    a, b = (r.s for r in rule_ensemble.with_statistics(df, ["doc_id"], "s").orderBy("doc_id").collect())
    assert (a.chars, a.words, a.lines, a.distinct_words) == (18, 6, 2, 4 / 6)
    assert a.upper == 3 / 18 and a.digits == 2 / 18 and a.symbols == 1 / 18 and a.repeated == 2 / 18
    assert b.chars == 0 and b.words == 1


M64 = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_ngrams(text, bits):
    """(buckets of words and pairs, buckets of 3 to 5 bytes), one n-gram after the other in whole numbers."""
    data, mask = text.encode(), (1 << bits) - 1
    words, last = [], None
    for w in data.split():
        words.append(0x2545F4914F6CDD1D if w == last else mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w)) & M64))
        last = w
    pairs = [mix((a * 0xD6E8FEB86659FD93 + b) & M64) for a, b in zip(words, words[1:])]
    chars = []
    for n in (3, 4, 5):
        for i in range(len(data) - n + 1):
            run = 0
            for b in data[i : i + n]:
                run = (run * 0x01000193 + b + 1) & 0xFFFFFFFF
            run = (run * 0x9E3779B1 + n) & 0xFFFFFFFF
            chars.append((run ^ run >> 15) & mask)
    return [(w >> 20) & mask for w in words + pairs], chars


TEXTS = ["good words here", "", "a", "BAD!! é ###", "good words here", "x x x y\n y  z", " ", "ab"]


@pytest.fixture(scope="module")
def small_model():
    return hashed_classifier.fit_texts(["good words here now"] * 30 + ["BAD!! BAD!! ###"] * 30, np.r_[np.ones(30), np.zeros(30)], bits=12)


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_hashed_scores_equal_plain_sums(small_model, monkeypatch, block):
    monkeypatch.setattr(hashed_classifier._char_hashes, "__defaults__", (block,))
    rng = np.random.default_rng(3)
    model = hashed_classifier.Model(rng.normal(size=1 << 12).astype(np.float32), rng.normal(size=1 << 12).astype(np.float32), 0.25, 1.0, 0.0)
    got = model.scores(*hashed_classifier.textvec.buffers(hashed_classifier.pa.array(TEXTS)))
    for text, score in zip(TEXTS, got):
        words, chars = plain_ngrams(text, 12)
        want = 0.25 + sum(sum(float(t[b]) for b in x) / max(1, len(x)) for t, x in ((model.word, words), (model.char, chars)))
        assert score == pytest.approx(want, rel=1e-6, abs=1e-9)
        f, v = hashed_classifier.features_of(np.frombuffer(text.encode(), np.uint8), 1 << 12)
        want = {}
        for half, x in enumerate((words, chars)):
            for b in x:
                want[b + (half << 12)] = want.get(b + (half << 12), 0) + 1 / len(x)
        assert dict(zip(f.tolist(), v.tolist())) == pytest.approx(want, rel=1e-5)
    p = small_model.probability(small_model.scores(*hashed_classifier.textvec.buffers(hashed_classifier.pa.array(TEXTS))))
    assert p[0] > 0.5 > p[3]


def test_calibration(spark, tables):
    """Platt scaling is where its loss is least, and what it says on unseen rows is about what comes true."""
    rng = np.random.default_rng(1)
    score = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2.5 * score - 0.7)))).astype(float)
    slope, shift = hashed_classifier._platt(score, y)
    assert slope == pytest.approx(2.5, abs=0.3) and shift == pytest.approx(-0.7, abs=0.2)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * score + b)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    assert all(loss(slope, shift) <= loss(slope + i, shift + j) + 1e-6 for i in (-0.05, 0, 0.05) for j in (-0.05, 0, 0.05))
    docs, seen, unseen = tables
    out = hashed_classifier.score(docs.join(unseen, "doc_id"), hashed_classifier.train(docs, seen), "p").select("quality", "p").toPandas()
    assert abs(out.p.mean() - out.quality.mean()) < 0.06 and np.mean((out.p - out.quality) ** 2) < 0.06


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(5)
    r = (rng.random((400, 30)) < 0.3).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 1] + 0.2)))).astype(float)
    weight = rng.random(400) + 0.5
    for penalty in (0.03, 0.01, 0.003):
        w, bias = rule_ensemble.lasso(r, y, weight, penalty, (np.zeros(30), 0.0), steps=5000)
        g = r.T @ (weight / weight.sum() * (1 / (1 + np.exp(-(r @ w + bias))) - y))
        on = np.abs(w) > 1e-9
        np.testing.assert_allclose(g[on], -penalty * np.sign(w[on]), atol=1e-5)
        assert (np.abs(g[~on]) <= penalty + 1e-5).all() and 0 < on.sum() < 30


def test_boosted_paths_are_conjunctions_over_statistics():
    rng = np.random.default_rng(6)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 2] <= 0.4)).astype(float)
    rules = rule_ensemble.tree_rules(x, y, np.ones(500))
    assert all(0 < len(r) <= 2 * 3 and all(0 <= j < 3 for j, _, _ in r) for r in rules)
    hit = rule_ensemble.applies(rules, x)
    assert max(np.mean(hit[:, k] == y) for k in range(len(rules))) > 0.97
    plain = [[all((x[i, j] <= c) == low for j, low, c in r) for r in rules] for i in range(50)]
    assert (hit[:50] == np.array(plain, float)).all()

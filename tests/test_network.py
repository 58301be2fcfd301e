"""The network: step by step equals at once, masks hold, and the kernels equal their definitions."""

import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import vectors as v
from quillframe.operators import network as net
from quillframe.operators import sequence, training


@pytest.fixture(scope="module", params=[0, 6])
def model(request):
    c = net.Config.of(window=request.param, unknown=1)
    return net.Network(c, net.init(c, 3))


def test_cached_equals_full(model):
    tokens = np.random.default_rng(1).integers(3, 250, 40)
    full, cells = model.advance(net.State(), tokens)
    state, parts = net.State(), []
    for a, b in ((0, 7), (7, 8), (8, 9), (9, 25), (25, 40)):
        parts.append(model.advance(state, tokens[a:b])[0])
    np.testing.assert_allclose(np.concatenate(parts), full, atol=1e-9)
    assert cells.shape == (40, 3, 64)


def test_future_is_not_seen(model):
    tokens = np.random.default_rng(2).integers(3, 250, 30)
    other = tokens.copy()
    other[20:] = 7
    np.testing.assert_allclose(model.logits(tokens)[:20], model.logits(other)[:20], atol=1e-12)
    assert np.abs(model.logits(tokens)[20:] - model.logits(other)[20:]).max() > 1e-6


def test_generate_and_heads(spark, model):
    out = model.generate([5, 6, 7], 10)
    tokens = [net.BOS, 5, 6, 7]
    for t in out["tokens"]:
        assert t == int(model.logits(np.array(tokens))[-1].argmax())
        tokens.append(t)
    assert model.generate([5], 0) == {"tokens": [], "logprobs": [], "min_prob": 0.0, "mean_logprob": float("-inf"), "max_entropy": 0.0}
    assert model.generate([5], 5, 1.0, 1) == model.generate([5], 5, 1.0, 1)
    e = model.embed(np.array([5, 6, 0, 0]))
    assert abs(e @ e - 1) < 1e-6 and 0 < model.confidence(np.array([5, 6])) < 1
    df = spark.createDataFrame([([5, 6, 7],), (None,)], "p array<int>")
    rows = net.generate(df, "p", model, 10).collect()
    assert rows[0].tokens == out["tokens"] and len(net.embed(df, "p", model).first().vector) == 32


def test_tiny_forward_sees_whole_turns(spark, tmp_path):
    from quillframe.plans import bulk

    texts = ["short", "", "a" + "same tail of two turns " * 40, "b" + "same tail of two turns " * 40, "z" * 70, None]
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    c = net.Config(longest=2000)
    whole = net.Network(c, net.init(c))
    got = {r.turn: r for r in bulk.tiny_forward(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        tokens, probs = [net.BOS, *(ord(x) % 256 for x in text or "")], []
        while len(probs) < 4:
            p = net.softmax(whole.logits(np.array(tokens))[-1])
            if p.argmax() == net.EOS:
                break
            tokens.append(int(p.argmax()))
            probs.append(float(p.max()))
        assert got[i].n_tokens == len(probs) and got[i].min_prob == pytest.approx(min(probs, default=0.0), rel=1e-6)


@pytest.mark.parametrize("given", [{}, {"window": 6, "longest": 64}, {"longest": 40}, {"memory_layers": (0,), "layers": 1}, {"memory_layers": (0, 1, 2), "layers": 3, "lanes": 3}])
@pytest.mark.parametrize("scale", [0.0, 0.3, 30.0])
def test_continuations_equal_generate(given, scale):
    c, rng = net.Config.of(**({"longest": 3000} | given)), np.random.default_rng(5)
    whole = net.Network(c, {k: x + scale * rng.standard_normal(x.shape) for k, x in net.init(c, 3).items()})
    prompts = [[], [5], [5, 6, 7], list(range(3, 80)), *[rng.integers(0, 250, n).tolist() for n in (net.TOGETHER - 1, net.TOGETHER, 2 * net.TOGETHER + 1, 90)]]
    for temperature in (0.0, 1.0):
        for got, prompt in zip(whole.continuations(prompts, 6, temperature, 4), prompts, strict=True):
            want = whole.generate(prompt, 6, temperature, 4)
            assert got["tokens"] == want["tokens"] and got["logprobs"] == pytest.approx(want["logprobs"], rel=1e-6, abs=1e-9)
            for k in ("min_prob", "mean_logprob", "max_entropy"):
                assert got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9)


def test_rows_are_decoded_together():
    """No row goes through the whole network position by position: a column takes a fraction of the time that rows one by one take."""
    c = net.Config(longest=700)
    whole, prompts = net.Network(c, net.init(c)), [np.random.default_rng(i).integers(3, 250, 300).tolist() for i in range(40)]
    began = time.process_time()
    want = [whole.generate(x, 4) for x in prompts]
    alone, began = time.process_time() - began, time.process_time()
    rows = net.generate(Here(pa.RecordBatch.from_arrays([pa.array(prompts)], ["p"])), "p", whole, 4)
    together = time.process_time() - began
    assert rows.column("tokens").to_pylist() == [x["tokens"] for x in want]
    assert together < alone / 3


class Here:
    """Stands in for a DataFrame: mapInArrow runs here, so that its time can be taken."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch, self.sparkSession, self.sparkContext, self.schema = batch, self, self, T.StructType([T.StructField("p", T.ArrayType(T.LongType()))])

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def mapInArrow(self, run, _):
        return next(run(iter([self.batch])))


def test_merge_average_and_budget():
    c = net.Config()
    p = net.init(c)
    adapter = net.low_rank(p, ["layer0.q"], 4)
    assert (net.merge(p, adapter, 2.0)["layer0.q"] == p["layer0.q"]).all()
    adapter["layer0.q"] = (np.ones((64, 1)), np.ones((1, 64)))
    assert np.allclose(net.merge(p, adapter, 0.5)["layer0.q"] - p["layer0.q"], 0.5)
    mean = net.average([p, {k: 3 * x for k, x in p.items()}])
    assert mean["layer0.k"].dtype == np.float16 and np.allclose(mean["layer0.k"], 2 * p["layer0.k"], atol=1e-2)
    assert sequence.window_budget(27, 4, 64, 512, 2, 1024) % 32 == 0 and sequence.window_budget(27, 4, 64, 512, 2, 1024, own=100) == 100


def test_kernels_in_numpy():
    x = np.random.default_rng(0).standard_normal((3, 16))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(16)] for i in range(16)]) / 4
    np.testing.assert_allclose(v.walsh(x), x @ h, atol=1e-12)
    np.testing.assert_allclose(v.walsh(v.walsh(x)), x, atol=1e-12)
    k = v.sinkhorn(x[:, :16].reshape(3, 4, 4), 50)
    np.testing.assert_allclose(k.sum(1), 1, atol=1e-6)
    np.testing.assert_allclose(k.sum(2), 1, atol=1e-4)
    assert net.ngram_slots(np.array([17, 5]), (2,), 1 << 20).shape == (2, 1)


def test_column_kernels(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0], [5, 1, 7], 0.0)], "x array<double>, t array<int>, z double")
    r = df.select(
        v.argmax(F.col("x")).alias("best"), v.softmax(F.col("x")).alias("p"), v.rms_unit(F.col("x")).alias("u"), v.zero_centred_rms(F.col("x"), F.array(*[F.lit(1.0)] * 4)).alias("zc"),
        v.unit(F.col("x")).alias("n"), v.rope(F.col("x"), F.lit(2)).alias("r"), v.ngram_slots(F.col("t"), 2, 0, 64).alias("g"), sequence.before_end(F.col("t"), 1).alias("cut"),
        sequence.left_pad(F.col("t"), 5).alias("pad"), v.absmax_quant(F.array(F.lit(0.0), F.lit(0.0)), 4).alias("q0"), training.warmup_cosine(F.lit(0), 1, 1.0).alias("lr"),
    ).first()
    x = np.array([1.0, 3.0, 3.0, -2.0])
    assert r.best == 1 and abs(sum(r.p) - 1) < 1e-12 and r.cut == [5] and r.pad == [0, 0, 5, 1, 7] and r.q0 == [0.0, 0.0]
    np.testing.assert_allclose(r.u, net.unit(x), atol=1e-9)
    np.testing.assert_allclose(r.zc, 2 * net.unit(x), atol=1e-9)
    np.testing.assert_allclose(r.n, x / np.sqrt(x @ x + 1e-12), atol=1e-12)
    turn = np.array([2.0, 2.0 / 100])
    want = np.r_[x[:2] * np.cos(turn) - x[2:] * np.sin(turn), x[2:] * np.cos(turn) + x[:2] * np.sin(turn)]
    np.testing.assert_allclose(r.r, want, atol=1e-12)
    assert r.g == net.ngram_slots(np.array([5, 1, 7]), (2,), 64)[:, 0].tolist()

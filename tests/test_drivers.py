"""Generation, tuning and building, checkpoints, Python tools, and the kernels that came with them."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import pieces as small_pieces

from quillframe.functions import bpe
from quillframe.functions import schema as s
from quillframe.functions import vectors as v
from quillframe.operators import agent, drivers, generation, network
from quillframe.operators import quantization as q
from quillframe.operators import sequence
from quillframe.sources import archive, jsonl

TOOLS = [{"name": "f", "parameters": {"type": "object", "properties": {}}}]


def generator():
    def unique(request, prompt):
        assert '"f"' in prompt
        return "Sure " + json.dumps([{"query": f"q {request}-{k}", "answers": []} for k in range(3)])

    return unique


def test_generation_reaches_the_target_exactly(spark):
    rows = generation.generate_dataset(spark, generator(), TOOLS, 10, batch=3, width=4).collect()
    assert len(rows) == len({r.query for r in rows}) == 10
    again = generation.generate_dataset(spark, generator(), TOOLS, 10, batch=3, width=2).collect()
    assert {r.query for r in again} == {r.query for r in rows}  # whatever ran beside what


def test_generation_dedups_and_ends(spark):
    same = lambda request, prompt: '[{"query": " Same ", "answers": []}, {"query": "same", "answers": []}]'
    assert generation.generate_dataset(spark, same, TOOLS, 5, batch=1, width=2).count() == 1

    def broken(request, prompt):
        raise RuntimeError("down")

    assert generation.generate_dataset(spark, broken, TOOLS, 5, batch=2, width=2).count() == 0
    assert generation.requests_for(10, 3, 4) == (4, 12) and generation.requests_for(1, 25, 8) == (1, 1)


def test_augment_appends(spark, tmp_path):
    (tmp_path / "seed.jsonl").write_text(json.dumps({"tools": TOOLS, "query": "q 0-0", "answers": []}) + "\n")
    seed = jsonl.read_examples(spark, str(tmp_path / "seed.jsonl"))
    tools = generation.first_tools(seed, "query")
    assert json.loads(tools) == TOOLS
    both = generation.augment(seed, generation.generate_dataset(spark, generator(), tools, 3, batch=3))
    assert both.count() == 4
    jsonl.write_examples(both, str(tmp_path / "out"))
    assert jsonl.read_examples(spark, str(tmp_path / "out")).count() == 4
    assert generation.prompt_of("[]", 7, 2).count("7") == 1


@pytest.fixture
def checkpoint(tmp_path):
    c = network.Config(vocab=300, width=16, heads=2, kv_heads=1, layers=1, memory_layers=(0,), slots=16, longest=256)
    network.write_checkpoint(f"file://{tmp_path}/base.npz", c, network.init(c, 1), step=7)
    return f"file://{tmp_path}/base.npz"


def test_finetune_then_build(spark, tmp_path, checkpoint):
    lines = [{"query": "a b", "answers": [{"name": "f", "arguments": {"x": i}}], "tools": []} for i in range(10)]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    said, p, out = [], small_pieces(), f"file://{tmp_path}/adapter.npz"
    done = drivers.finetune(spark, str(tmp_path / "x.jsonl"), checkpoint, out, p, epochs=2, batch=8, rank=4, alpha=8.0, hold_out=0.2, rate=0.05, progress=said.append)
    assert any("loss" in x for x in said) and any("val" in x for x in said) and done["examples"] == 8
    pairs, head = network.read_adapter(out)
    assert head["rank"] == 4 and head["scale"] == 2.0 and head["base"] == checkpoint and pairs
    params, config, _ = network.read_checkpoint(checkpoint)
    assert all(a.shape == (params[n].shape[0], 4) and np.abs(b).max() > 0 for n, (a, b) in pairs.items())
    rows, width = drivers.encoded(spark, str(tmp_path / "x.jsonl"), p, 256)
    assert width == 128 or width == 256
    model = network.Network(config, params)
    total = n = 0
    for r in rows.collect():
        ids = [x for x in r.ids if x != 0] if 0 not in r.ids[: sum(x != 0 for x in r.ids)] else r.ids
        logp = np.log(network.softmax(model.logits(np.array(ids[:-1]))))
        on = np.array(r.mask[1 : len(ids)], bool)
        total -= logp[np.arange(len(ids) - 1), ids[1:]][on].sum()
        n += on.sum()
    assert drivers.losses(rows, config, [params])[0] == pytest.approx(total / n, rel=1e-9)
    info = drivers.build(checkpoint, f"file://{tmp_path}/m.bin", out, group=16, pieces=p)
    read = {r.name: r for r in archive.read(spark, info["path"]).collect()}
    assert len(read) == info["tensors"] and bpe.Pieces.from_blob(bytes(read["tokenizer"].blob)) == p
    order = [r.name for r in sorted(read.values(), key=lambda r: r.ordinal)]
    assert order[0] == "embedding" and order[1:4] == ["layer0.norm_in", "layer0.q", "layer0.k"] and order.index("final_norm") < order.index("contrast.probes") < order.index("tokenizer")
    merged = network.merge(params, pairs, 2.0)["layer0.q"]
    assert np.corrcoef(read["layer0.q"]["values"], merged.ravel())[0, 1] > 0.9
    (tmp_path / "none.jsonl").write_text('{"tools": []}\n')
    with pytest.raises(ValueError, match="no usable"):
        drivers.finetune(spark, str(tmp_path / "none.jsonl"), checkpoint, out, p)


def test_checkpoints_know_their_format(tmp_path, checkpoint, monkeypatch):
    params, config, head = network.read_checkpoint(checkpoint)
    assert config.memory_layers == (0,) and head["step"] == 7
    other = f"file://{tmp_path}/other.npz"
    network.write_checkpoint(other, config, {k: x + 1 for k, x in params.items()}, step=9)
    assert network.average_files([checkpoint, other], f"file://{tmp_path}/mean.npz") == [7, 9]
    mean, _, head = network.read_checkpoint(f"file://{tmp_path}/mean.npz")
    assert head["run"] == {"averaged_from": [7, 9]} and mean["final_norm"].dtype == np.float16 and np.allclose(mean["final_norm"], 0.5)
    with pytest.raises(ValueError, match="no adapter"):
        network.read_adapter(checkpoint)
    (tmp_path / "bad.npz").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="bad.npz"):
        network.read_checkpoint(f"file://{tmp_path}/bad.npz")
    monkeypatch.setattr(network, "FORMAT", 2)
    with pytest.raises(ValueError, match="format version 2"):
        network.read_checkpoint(checkpoint)


def test_streamed_tokens_are_the_generated_ones():
    c = network.Config(vocab=64, width=16, heads=2, kv_heads=1, layers=1, memory_layers=(), longest=64)
    model = network.Network(c, network.init(c, 3))
    for temperature in (0.0, 0.8):
        whole = model.generate([5, 6, 7], 12, temperature, 4)
        steps = list(model.stream([5, 6, 7], 12, temperature, 4))
        assert [x[0] for x in steps] == whole["tokens"] and np.allclose(np.log([x[1] for x in steps]), whole["logprobs"])
        p = network.softmax(model.logits(np.array([network.BOS, 5, 6, 7, *whole["tokens"]])))
        assert np.allclose(whole["logprobs"], [np.log(p[3 + i, t]) for i, t in enumerate(whole["tokens"])])


def test_python_tools_and_what_they_raise(spark):
    def weather(city: str):
        "Weather of a city."
        if city == "nowhere":
            raise KeyError(city)
        return {"temp": len(city)}

    def propose(df):
        name = F.get("plan", F.col("steps"))
        return df.withColumn("call", F.when(name.isNotNull(), F.struct(name["name"].alias("name"), name["argument"].alias("argument"))))

    plan = [("weather", '{"city": "Oslo"}'), ("weather", '{"city": "nowhere"}'), ("weather", "{}"), ("radar", "{}")]
    df = spark.createDataFrame([(plan, "go"), ([], "go")], "plan array<struct<name string, argument string>>, q string")
    one = agent.Agent.with_python_tools([weather, {"name": "radar"}], propose, max_steps=6)
    got = {r.steps: r for r in one.run(df, "q").collect()}
    assert got[0].type == "respond" and [json.loads(x) for x in got[4].results][:2] == [{"temp": 4}, {"error": "'nowhere'"}]
    assert "city" in json.loads(got[4].results[2])["error"] and json.loads(got[4].results[3]) == {"error": "unknown tool: radar"}
    s.tool_udf(spark, s.tool(weather))
    assert spark.sql("""SELECT weather('{"city": "Rome"}') AS r""").first().r == '{"temp": 4}'


def test_extraction_takes_the_first_call(spark):
    schema = {"name": "p", "parameters": {"type": "object", "properties": {"name": {"type": "string", "minLength": 2}, "age": {"type": "integer"}}, "required": ["name"]}}
    one = agent.Agent({}, lambda df: df, [schema])
    df = spark.createDataFrame([(1, ['{"name": "Al", "age": 3}', '{"name": "B"}']), (2, []), (3, None), (4, ['{"age": 1}'])], "i int, c array<string>")
    got = {r.i: (r.record and tuple(r.record), r.violations) for r in one.extract(df, "c").collect()}
    assert got == {1: (("Al", 3), []), 2: (None, None), 3: (None, None), 4: ((None, 1), ["name.required"])}


def test_ids_are_those_of_the_library():
    path = "/opt/tokenizers/piece_bpe_32k.model"
    sentencepiece = pytest.importorskip("sentencepiece")
    try:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
    except OSError:
        pytest.skip("no tokenizer here")
    p = bpe.Pieces.from_model(path, ("<|im_start|>",))
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/conversations.parquet")["text"].to_pylist()[:200] + ["a  b", "naïve 東京 \n x", "   lead", "trail  "]
    assert [p.encode(t) for t in texts] == [sp.encode(t) for t in texts]
    assert p.encode("a<|im_start|>b")[1:-1].count(p.ids["<|im_start|>"]) == 1 and p.size == sp.get_piece_size() + 1 and len(p.md5) == 32
    assert p.batch(["a b c d"], 2) == [p.encode("a b c d")[:2]]


def test_vector_kernels_are_linear(spark):
    x = np.random.default_rng(0).standard_normal((40, 4096))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>").cache()
    df.count()
    began = time.time()
    got = df.select("i", v.softmax(F.col("x")).alias("p"), v.rms_unit(F.col("x")).alias("r"), v.unit(F.col("x")).alias("u"), v.absmax_groups(F.col("x"), 4, 100).alias("q")).orderBy("i").toPandas()
    assert time.time() - began < 20
    e = np.exp(x - x.max(1, keepdims=True))
    np.testing.assert_allclose(np.stack(got.p), e / e.sum(1, keepdims=True))
    np.testing.assert_allclose(np.stack(got.r), x / np.sqrt((x * x).mean(1, keepdims=True) + 1e-6))
    np.testing.assert_allclose(np.stack(got.u), x / np.sqrt((x * x).sum(1, keepdims=True) + 1e-12))
    want = np.concatenate([np.rint(g / (z := np.abs(g).max(1, keepdims=True) / 7)) * z for g in np.split(x, range(100, 4096, 100), 1)], 1)
    np.testing.assert_allclose(np.stack(got.q), want, atol=1e-12)


def test_small_operators(spark):
    df = spark.createDataFrame([(["a", "b", "kernel"], [[1, 0, 0], [1, 1, 0], [0, 1, 1]], [5, 0, 6])], "k array<string>, m array<array<int>>, t array<int>")
    r = df.select(q.leaf_path(F.col("k")).alias("p"), *[sequence.mask_diagonal(F.col("m"), d).alias(f"d{d}") for d in range(4)], sequence.padding_mask(F.col("t")).alias("pad"), q.straight_through(F.lit(2.0), F.lit(3.0), F.lit(True)).alias("st")).first()
    assert r.p == "a/b/kernel" and [r.d0, r.d1, r.d2, r.d3] == [[1, 1, 1], [0, 1, 1], [0, 0, 0], [0, 0, 0]] and r.pad == [1, 0, 1] and r.st == 3.0
    x = np.random.default_rng(2).standard_normal((2, 3, 100))
    assert q.kv_quant(x, 0) is x and np.corrcoef(q.kv_quant(x, 4).ravel(), x.ravel())[0, 1] > 0.98
    noise = q.add_noise(np.ones((200, 100)), 0.1, 64, 5) - 1
    assert noise.shape == (200, 100) and 0.05 < noise[:, :64].std() < 0.15 and abs(noise.mean()) < 0.01
    tree = q.noisy({"a": np.ones((4, 4)), "b": np.ones((4, 4)), "n": np.ones(4)}, 0.1, 4, prefix="a")
    assert (tree["b"] == 1).all() and (tree["n"] == 1).all() and (tree["a"] != 1).all()
    rows = spark.createDataFrame([("low.x", x[0, 0].tolist()), ("x", x[0, 1].tolist())], "name string, row array<double>")
    got = {r.name: np.array(r.row) for r in q.quantize_rows(rows, "name", "row", {"low": 2}, 4, 64).collect()}
    for n, bits, w in (("low.x", 2, x[0, 0]), ("x", 4, x[0, 1])):
        np.testing.assert_allclose(got[n], q.dequantize(*q.quantize(w[None], bits, 64), 100, bits, 64)[0])


def test_retrieval_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    tools, asks = rng.standard_normal((300, 8)), rng.standard_normal((40, 8))
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(tools)], "tool int, e array<double>")
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asks)], "id int, q array<double>")
    want = {(i, int(j), k + 1) for i in range(40) for k, j in enumerate(np.lexsort((np.arange(300), -np.round(tools @ asks[i], 6)))[:5])}
    for block, limit in ((4096, 1 << 25), (16, 1 << 25), (16, 0)):
        monkeypatch.setattr(agent, "BLOCK", block)
        monkeypatch.setattr(agent, "BROADCAST_BYTES", limit)
        assert {(r.id, r.tool, r["rank"]) for r in agent.retrieve(d, t).collect()} == want
    assert agent.retrieve(d, t.limit(0)).count() == 0

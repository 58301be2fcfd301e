"""Registered queries whose work runs in Arrow batches, data sources or streams."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from quillframe.cluster import file_system, new_path, settle
from quillframe.functions import bpe
from quillframe.functions import vectors as v
from quillframe.operators import network as net
from quillframe.operators import quantization as q
from quillframe.operators.dataset import code_points
from quillframe.plans.dataset import registered, table
from quillframe.plans.kernels import X, checksum, vectors
from quillframe.sources import archive
from quillframe.streaming import state

QUERIES, SQL, query = registered()
TOKENIZER = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@query("SELECT conv_id, turn, text FROM conversations")
def bpe_roundtrip(spark, sf, path: str = TOKENIZER):
    """Every turn to ids and back: the text returns. The ids themselves are held against the tokenizer's own library in the tests."""
    pieces = bpe.Pieces.from_model(path, ("<|im_start|>", "<|im_end|>"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    back = bpe.with_text(bpe.with_ids(c, "text", pieces).drop("text"), "ids", pieces, "text")
    return back.select("conv_id", "turn", "text")


@query(f"""WITH RECURSIVE a AS ({X}), f AS (SELECT vec_id, unnest(x) AS v, unnest(range(64)) AS p FROM a),
r(vec_id, p, v, n) AS (SELECT vec_id, p, v, 0 FROM f UNION ALL
  SELECT vec_id, p, v - ln(sum(exp(v)) OVER (PARTITION BY vec_id, p // 16, p % 4)), n + 1
  FROM (SELECT vec_id, p, n, v - ln(sum(exp(v)) OVER (PARTITION BY vec_id, p // 4)) AS v FROM r WHERE n < 20))
SELECT vec_id, round(sum(exp(v) * (p + 1)), 6) AS s FROM r WHERE n = 20 GROUP BY vec_id""")
def sinkhorn(spark, sf):
    """Each vector as four matrices of 4 x 4 logits, whose rows and columns are made to sum to 1."""
    k = v.map_rows(vectors(spark, sf).select("vec_id", "x"), "x", lambda a: v.sinkhorn(a.reshape(-1, 4, 4)).reshape(len(a), -1), "k")
    return k.select("vec_id", checksum(F.col("k")).alias("s"))


BOOK = q.codebook(4, 64)
TURN = "list_transform(range(64), lambda i: list_sum(list_transform(range(64), lambda j: {0}[j + 1] * CASE WHEN bit_count(i & j) % 2 = 0 THEN 1 ELSE -1 END)) / 8)"
#: Rotation, norm in half precision (11 significant bits), nearest code, and back.
QUANTIZED = f"""WITH a AS ({X}), t AS (SELECT vec_id, {TURN.format("x")} AS t FROM a), n AS (SELECT vec_id, t, sqrt(list_sum(list_transform(t, lambda e: e * e))) AS n FROM t),
h AS (SELECT vec_id, t, n, round_even(n / pow(2.0, floor(log2(n)) - 10), 0) * pow(2.0, floor(log2(n)) - 10) AS h FROM n),
c AS (SELECT vec_id, list_transform(t, lambda e: list_extract({[float(x) for x in BOOK]}::DOUBLE[], 1 + len(list_filter({[float(x) for x in (BOOK[1:] + BOOK[:-1]) / 2]}::DOUBLE[], lambda m: m < e / n))) * h) AS c FROM h),
y AS (SELECT vec_id, {TURN.format("c")} AS y FROM c)
"""


@query(QUANTIZED + "SELECT vec_id, round(list_sum(list_transform(y, lambda e, i: e * i)), 6) AS s FROM y")
def rotated_quant(spark, sf):
    """Rotated group quantization of every vector, and back."""
    back = v.map_rows(vectors(spark, sf).select("vec_id", "x"), "x", lambda a: q.dequantize(*q.quantize(a, 4, 64), a.shape[1], 4, 64), "y")
    return back.select("vec_id", checksum(F.col("y")).alias("s"))


#: Vectors of one archived tensor, about.
BLOCK = 512


@query(QUANTIZED + "SELECT vec_id, round(list_sum(list_transform(y, lambda e, i: CAST(CAST(e AS FLOAT) AS DOUBLE) * i)), 4) AS s FROM y")
def archive_roundtrip(spark, sf):
    """All vectors in blocks, quantized into an archive a block by tasks, and read through the data source."""
    folder = new_path(spark, "archives")
    path, store = file_system(spark, folder)
    store.mkdirs(path)
    x = vectors(spark, sf).select("vec_id", "x")
    blocks = max(1, -(-x.count() // BLOCK))
    x = x.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))

    def save(frame):
        block = int(frame["block"].iloc[0])
        frame = frame.sort_values("vec_id")
        archive.write([(f"block{block}", np.stack(frame["x"].to_numpy()))], f"{folder}/{block}.bin", default=4, group=64)
        return frame.assign(file=f"{folder}/{block}.bin", name=f"block{block}", at=range(len(frame)))[["vec_id", "file", "name", "at"]]

    places = settle(x.groupBy("block").applyInPandas(save, "vec_id long, file string, name string, at int"), "places")
    files = [r.file for r in places.select("file").distinct().collect()]  # a name a block
    back = archive.read(spark, ",".join(sorted(files))).select("name", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("shape")[0] - 1), lambda i: F.slice("values", i * 64 + 1, 64))).alias("at", "y"))
    found = places.join(back, ["name", "at"]).select("vec_id", F.col("y").cast("array<double>").alias("y"))
    return found.select("vec_id", F.round(v.total(F.transform("y", lambda e, i: e * (i + 1))), 4).alias("s"))


@query(None)
def tiny_forward(spark, sf):
    """Greedy continuation of every whole turn by a seeded network that holds the longest, with the signals of its steps."""
    turns, most = table(spark, sf, "conversations"), 4
    longest = turns.agg(F.max(F.length("text"))).first()[0] or 0
    c = net.Config(longest=longest + most + 2)
    model = net.Network(c, net.init(c))
    spread = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # small files take long here
    t = turns.select("conv_id", "turn", "text").repartition(spread).select("conv_id", "turn", F.transform(code_points(F.col("text")), lambda x: x % 256).alias("prompt"))
    rows = net.generate(t.withColumn("prompt", F.when(F.size("prompt") > 0, F.col("prompt"))), "prompt", model, most=most)
    return rows.select("conv_id", "turn", F.size("tokens").alias("n_tokens"), "min_prob", "mean_logprob", "max_entropy")


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts, count(*) AS n FROM events GROUP BY user_id, event_type")
def stream_dedup(spark, sf):
    """The first event of each user and type, as a stream of all that is there; later batches can still bring an earlier one."""
    first = state.first_wins(_events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "ts"])
    out = state.run_to_table(first, new_path(spark, "stream"), new_path(spark, "stream-checkpoint"), "update")
    last = out.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "ts", "n"), "_batch").alias("s"))
    return last.select("user_id", "event_type", "s.event_id", "s.ts", "s.n")


@query("""WITH x AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS r FROM events),
y AS (SELECT user_id, r, sum(CAST(r AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g, sum(CAST(r AS INTEGER)) OVER (PARTITION BY user_id) AS resets FROM x)
SELECT user_id, CAST(sum(CASE WHEN g = resets AND NOT r THEN 1 ELSE 0 END) AS BIGINT) AS turns, CAST(max(resets) AS BIGINT) AS resets FROM y GROUP BY user_id""")
def session_state(spark, sf):
    """The turns of each user since the last purchase, which resets the conversation."""
    turns = state.conversation_state(_events(spark, sf), "user_id", "event_type", "purchase", ["ts", "event_id"])
    out = state.run_to_table(turns, new_path(spark, "stream"), new_path(spark, "stream-checkpoint"), "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("turns", "resets"), "_batch").alias("s")).select("user_id", "s.turns", "s.resets")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
y AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM y GROUP BY user_id, s""")
def sessions(spark, sf):
    """Events of a user at most 30 minutes apart."""
    w = F.session_window("ts", "30 minutes")
    return table(spark, sf, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")

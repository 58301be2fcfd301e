"""Registered queries over sequences, vectors, quantization and training sums, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.cluster import maybe_broadcast, prefix_sums, settle
from quillframe.functions import vectors as v
from quillframe.operators import quantization as q
from quillframe.operators import sequence as s
from quillframe.operators import training as t
from quillframe.operators.dataset import code_points
from quillframe.plans.dataset import registered, table

QUERIES, SQL, query = registered()


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


X = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
CHECK = "list_sum(list_transform(y, lambda e, i: e * i))"


def checksum(a):
    """Sum of the elements times their places from 1."""
    return F.round(v.total(F.transform(a, lambda e, i: e * (i + 1))), 6)


@query("SELECT event_id, lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value FROM events")
def shift_lag(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", s.shift(F.col("value"), 1, ["user_id"], ["ts", "event_id"]).alias("prev_value"))


@query("SELECT a.conv_id, a.turn, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn AND a.turn - b.turn < 3 GROUP BY a.conv_id, a.turn")
def segment_frame_count(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.count(F.lit(1)).over(s.recent(["conv_id"], "turn", 3)).alias("n"))


@query("""
SELECT a.conv_id, a.turn, count(*) AS visible, CAST(sum(length(b.text)) AS BIGINT) AS chars
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn AND (a.turn - b.turn < 3 OR b.turn < 1)
GROUP BY a.conv_id, a.turn""")
def window_sink_mask(spark, sf):
    """What each turn sees: the last three turns, and always the sinks (turn 0)."""
    c = table(spark, sf, "conversations").withColumn("sink", F.col("turn") < 1)
    visible, chars = s.visible_sums(["conv_id"], "turn", "sink", 3, [F.lit(1), F.length("text")])
    return c.select("conv_id", "turn", visible.alias("visible"), chars.alias("chars"))


def _gram(order: int, tab: int) -> str:
    acc = str((0x9E3779B9 * (tab + 1)) & 0xFFFFFFFF)
    for j in range(order):
        token = "x" if j == 0 else f"CASE WHEN i > {j} THEN c[i - {j}] ELSE 0 END"
        acc = f"((xor(CAST({acc} AS BIGINT), CAST({token} AS BIGINT)) * 16777619) & 4294967295)"
    return f"CAST(coalesce(list_sum(list_transform(c, lambda x, i: xor({acc}, {acc} >> 15) % 4096)), 0) AS BIGINT)"


@query(f"""WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda z: unicode(z)) AS c FROM conversations)
SELECT conv_id, turn, {_gram(2, 0)} AS bi, {_gram(3, 1)} AS tri FROM w""")
def ngram_hash(spark, sf):
    """Slots of all bigrams and trigrams of code points, summed by turn."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", code_points(F.col("text")).alias("c"))
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return c.select("conv_id", "turn", add(v.ngram_slots(F.col("c"), 2, 0, 4096)).alias("bi"), add(v.ngram_slots(F.col("c"), 3, 1, 4096)).alias("tri"))


@query("SELECT doc_id, md5(CASE WHEN strpos(text, '.') > 0 THEN left(text, strpos(text, '.') - 1) ELSE text END) AS prefix_md5 FROM documents")
def cut_at_eos(spark, sf):
    """What precedes the first end mark."""
    return table(spark, sf, "documents").select("doc_id", F.md5(F.substring_index("text", ".", 1)).alias("prefix_md5"))


@query(f"""WITH a AS ({X}), b AS (SELECT vec_id, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda f: f * f)) / len(x) + 1e-6)) AS y FROM a)
SELECT vec_id, round({CHECK}, 6) AS s FROM b""")
def rms_norm(spark, sf):
    return vectors(spark, sf).select("vec_id", checksum(v.rms_unit(F.col("x"))).alias("s"))


@query(f"""WITH a AS ({X}), e AS (SELECT vec_id, x, list_transform(x, lambda f: exp(f - list_max(x))) AS e FROM a),
p AS (SELECT vec_id, x, list_transform(e, lambda f: f / list_sum(e)) AS p FROM e)
SELECT vec_id, round(list_max(p), 9) AS max_prob, round(-list_sum(list_transform(p, lambda f: f * ln(f))), 6) AS entropy, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS best FROM p""")
def softmax_entropy(spark, sf):
    p = vectors(spark, sf).withColumn("p", v.softmax(F.col("x")))
    return p.select("vec_id", F.round(F.array_max("p"), 9).alias("max_prob"), F.round(v.entropy(F.col("p")), 6).alias("entropy"), v.argmax(F.col("x")).alias("best"))


@query(f"""WITH a AS ({X}), e AS (SELECT label, list_transform(x, lambda f: exp(f - list_max(x))) AS e FROM a), p AS (SELECT label, list_transform(e, lambda f: f / list_sum(e)) AS p FROM e)
SELECT label, round(min(list_max(p)), 9) AS min_prob, round(avg(ln(greatest(list_max(p), 1e-12))), 6) AS mean_logprob, round(max(-list_sum(list_transform(p, lambda f: f * ln(f)))), 6) AS max_entropy FROM p GROUP BY label""")
def sequence_signals(spark, sf):
    p = vectors(spark, sf).withColumn("p", v.softmax(F.col("x"))).select("label", F.array_max("p").alias("chosen"), v.entropy(F.col("p")).alias("h"))
    low, mean, high = t.signals("chosen", "h")
    return p.groupBy("label").agg(F.round(low, 9).alias("min_prob"), F.round(mean, 6).alias("mean_logprob"), F.round(high, 6).alias("max_entropy"))


@query(f"""WITH a AS ({X}), y AS (SELECT vec_id, list_transform(range(64), lambda i: list_sum(list_transform(range(64), lambda j: x[j + 1] * CASE WHEN bit_count(i & j) % 2 = 0 THEN 1 ELSE -1 END)) / 8) AS y FROM a)
SELECT vec_id, round({CHECK}, 6) AS s FROM y""")
def hadamard64(spark, sf):
    """The Walsh-Hadamard rotation in Arrow batches, n log n a row."""
    return v.map_rows(vectors(spark, sf).select("vec_id", "x"), "x", v.walsh, "y").select("vec_id", checksum(F.col("y")).alias("s"))


@query(f"""WITH a AS ({X}), r AS (SELECT vec_id, list_transform(range(32), lambda i: x[i + 1] * cos(label * pow(10000.0, -(i * 2.0) / 64)) - x[i + 33] * sin(label * pow(10000.0, -(i * 2.0) / 64)))
  || list_transform(range(32), lambda i: x[i + 33] * cos(label * pow(10000.0, -(i * 2.0) / 64)) + x[i + 1] * sin(label * pow(10000.0, -(i * 2.0) / 64))) AS y FROM a)
SELECT vec_id, round({CHECK}, 6) AS s FROM r""")
def rope_rotate(spark, sf):
    return vectors(spark, sf).select("vec_id", checksum(v.rope(F.col("x"), F.col("label"))).alias("s"))


@query(f"""WITH a AS ({X}), m AS (SELECT vec_id, x, list_max(list_transform(x, lambda e: abs(e))) / 7 AS z FROM a),
y AS (SELECT vec_id, list_transform(x, lambda e: least(7.0, greatest(-8.0, round_even(e / z, 0))) * z) AS y FROM m)
SELECT vec_id, round({CHECK}, 6) AS s FROM y""")
def absmax_quant(spark, sf):
    return vectors(spark, sf).select("vec_id", checksum(v.absmax_quant(F.col("x"), 4)).alias("s"))


@query(f"""WITH a AS ({X}), m AS (SELECT vec_id, list_transform(range(2), lambda g: x[g * 32 + 1:g * 32 + 32]) AS g, list_max(list_transform(x, lambda e: abs(e))) / 127 AS z, x FROM a),
y AS (SELECT vec_id, flatten(list_transform(g, lambda q: list_transform(q, lambda e: least(7.0, greatest(-8.0, round_even(e / (list_max(list_transform(q, lambda f: abs(f))) / 7), 0))) * (list_max(list_transform(q, lambda f: abs(f))) / 7)))) AS y,
  list_transform(x, lambda e: least(127.0, greatest(-128.0, round_even(e / z, 0))) * z) AS w FROM m)
SELECT vec_id, round({CHECK}, 6) AS grouped, round({CHECK.replace('(y,', '(w,')}, 6) AS activation FROM y""")
def group_quant(spark, sf):
    """Weights on the grid of each run of 32, activations in 8 bits on that of the whole vector."""
    x = vectors(spark, sf)
    return x.select("vec_id", checksum(v.absmax_groups(F.col("x"), 4, 32)).alias("grouped"), checksum(v.absmax_quant(F.col("x"), 8)).alias("activation"))


BOOK = [-0.18875, -0.056625, 0.056625, 0.18875]
CODES = "list_transform(x, lambda e: CAST((e > -0.1226875) AS INTEGER) + CAST((e > 0.0) AS INTEGER) + CAST((e > 0.1226875) AS INTEGER))"


def codes(spark, sf):
    return vectors(spark, sf).select("vec_id", "label", "x", F.transform("x", lambda e: v.nearest_code(e, BOOK)).alias("c"))


@query(f"WITH a AS ({X}), c AS (SELECT vec_id, {CODES} AS y FROM a) SELECT vec_id, CAST({CHECK} AS BIGINT) AS s FROM c")
def nearest_code(spark, sf):
    return codes(spark, sf).select("vec_id", F.aggregate(F.transform("c", lambda e, i: e * (i + 1)), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("s"))


@query(f"""WITH a AS ({X}), c AS (SELECT label, x, {CODES} AS c FROM a), f AS (SELECT label, unnest(x) AS x, [-0.18875, -0.056625, 0.056625, 0.18875][unnest(c) + 1]::DOUBLE AS d FROM c)
SELECT label, round(avg((d - x) * (d - x)) / avg(x * x), 6) AS distortion FROM f GROUP BY label""")
def quant_distortion(spark, sf):
    rows = codes(spark, sf).select("label", F.explode(F.arrays_zip("x", "c")).alias("z"))
    back = F.get(F.array(*[F.lit(b) for b in BOOK]), F.col("z.c"))
    return rows.groupBy("label").agg(F.round(q.distortion(F.col("z.x"), back), 6).alias("distortion"))


@query(f"""WITH a AS ({X}), c AS (SELECT vec_id, {CODES} AS c FROM a)
SELECT vec_id, """ + ", ".join(f"CAST(list_sum(list_transform(range(16), lambda i: CAST(c[i + {1 + 16 * w}] AS BIGINT) << CAST(2 * i AS INTEGER))) AS BIGINT) AS w{w}" for w in range(4)) + " FROM c")
def pack_bits(spark, sf):
    """64 two-bit codes a row in four words, least significant first."""
    return codes(spark, sf).select("vec_id", *[v.pack_codes(F.col("c"), 2, 16 * w, 16).alias(f"w{w}") for w in range(4)])


@query("SELECT doc_id, CAST(coalesce(sum((strlen(text) + 63) // 64 * 64) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents")
def align_offsets(spark, sf):
    """Where each blob starts when all are laid out in order on boundaries of 64 bytes."""
    d = table(spark, sf, "documents").select("doc_id", q.aligned(F.octet_length("text")).cast("bigint").alias("room"))
    return prefix_sums(d, ["doc_id"], "room", "stop").select("doc_id", (F.col("stop") - F.col("room")).alias("start"))


@query(f"""WITH a AS ({X}), w AS (SELECT label, x, exp(x[1] / 8) AS e FROM a), f AS (SELECT label, e, unnest(x) AS v, unnest(range(64)) AS j FROM w)
SELECT label, CAST(j AS INTEGER) AS j, round(sum(e * v) / sum(e), 6) AS pooled FROM f GROUP BY label, j""")
def probe_pool(spark, sf):
    """Attention pooling of each label's vectors by a probe along the first axis."""
    rows = vectors(spark, sf).select("label", (F.get("x", F.lit(0)) / 8.0).alias("score"), F.posexplode("x").alias("j", "v"))
    return rows.groupBy("label", "j").agg(F.round(F.sum(F.exp("score") * F.col("v")) / F.sum(F.exp("score")), 6).alias("pooled"))


@query(f"WITH a AS ({X}), f AS (SELECT label, unnest(x) AS v, unnest(range(64)) AS j FROM a) SELECT label, CAST(j AS INTEGER) AS j, round(avg(v), 6) AS mean FROM f GROUP BY label, j")
def element_average(spark, sf):
    """The element-wise mean of tensors, as for averaging checkpoints."""
    return t.element_mean(vectors(spark, sf), "label", "x").select("label", "j", F.round("mean", 6).alias("mean"))


@query(f"""WITH a AS ({X}), l AS (SELECT label, j, avg(v) AS b FROM (SELECT label, unnest(x) AS v, unnest(range(64)) AS j FROM a) GROUP BY label, j),
f AS (SELECT vec_id, unnest(x) AS w, unnest(range(64)) AS j FROM a), p AS (SELECT vec_id, j % 10 AS k, sum(w) AS a FROM f GROUP BY vec_id, k)
SELECT f.vec_id, CAST(f.j AS INTEGER) AS j, round(any_value(w) + 2.0 * sum(p.a * b), 6) AS merged FROM f JOIN p ON f.vec_id = p.vec_id JOIN l ON f.j = l.j AND l.label = p.k GROUP BY f.vec_id, f.j""")
def matmul_merge(spark, sf):
    """W + scale * A @ B in long form: A sums the axes by their last digit, B holds the means of all ten labels."""
    x = vectors(spark, sf)
    w = x.select(F.col("vec_id").alias("i"), F.posexplode("x").alias("j", "w"))
    a = w.groupBy("i", (F.col("j") % 10).alias("k")).agg(F.sum("w").alias("a"))
    b = t.element_mean(x, "label", "x").select(F.col("label").alias("k"), "j", F.col("mean").alias("b"))
    return t.merge_low_rank(w, a, maybe_broadcast(settle(b, "low_rank"), 32), 2.0).select(F.col("i").alias("vec_id"), "j", F.round("w", 6).alias("merged"))


@query("""WITH n AS (SELECT 3 * ((count(*) + 15) // 16) AS total FROM documents), w AS (SELECT total, least(greatest(1, total // 20), total - 1) AS warm FROM n),
s AS (SELECT unnest(range(CAST(total AS BIGINT))) AS step, total, warm FROM w)
SELECT step, round(CASE WHEN step < warm THEN 0.001 * step / warm ELSE 0.001 * 0.5 * (1 + cos(pi() * (step - warm) / (total - warm))) END, 10) AS lr FROM s""")
def lr_schedule(spark, sf):
    """The rate of every step of three epochs in batches of 16."""
    total = 3 * -(-table(spark, sf, "documents").count() // 16)
    return spark.range(total).select(F.col("id").alias("step"), F.round(t.warmup_cosine(F.col("id"), total, 1e-3), 10).alias("lr"))


@query("""WITH x AS (SELECT conv_id, ln(1 + lead(length(text)) OVER w) AS ce, CAST(lead(role) OVER w = 'assistant' AS INTEGER) AS m FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, round(sum(coalesce(ce * m, 0)) / greatest(sum(coalesce(m, 0)), 1), 6) AS loss FROM x GROUP BY conv_id""")
def masked_loss(spark, sf):
    """Mean over the masked next positions of each sequence."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations")
    rows = c.select("conv_id", F.ln(1 + F.lead(F.length("text")).over(w)).alias("ce"), (F.lead("role").over(w) == "assistant").cast("int").alias("m"))
    return rows.groupBy("conv_id").agg(F.round(t.masked_mean("ce", "m"), 6).alias("loss"))


@query("SELECT lang, round(avg(m), 6) AS val FROM (SELECT lang, doc_id // 16 AS b, avg(ln(1 + n_chars)) AS m FROM documents GROUP BY lang, b) GROUP BY lang")
def validation_metric(spark, sf):
    """The mean of batch means, each batch counting alike."""
    d = table(spark, sf, "documents").withColumn("b", F.floor(F.col("doc_id") / 16))
    return t.mean_of_means(d, ["lang"], "b", F.ln(1 + F.col("n_chars"))).select("lang", F.round("mean", 6).alias("val"))


PREFIXES = {"default": 4, "ECONOMY": 2, "ECONOMY ANODIZED": 3, "PROMO": 2, "STANDARD POLISHED": 3, "STANDARD": 4, "SMALL": 2, "LARGE": 3}


@query("""WITH p(prefix, bits) AS (VALUES """ + ", ".join(f"('{k}', {b})" for k, b in PREFIXES.items() if k != "default") + """)
SELECT p_partkey, coalesce(arg_max(bits, length(prefix)), 4) AS bits FROM part LEFT JOIN p ON starts_with(p_type, prefix) GROUP BY p_partkey""")
def longest_prefix(spark, sf):
    """The width of the longest prefix that a name has, else the default."""
    return q.longest_prefix(table(spark, sf, "part").select("p_partkey", "p_type"), "p_partkey", "p_type", {k: b for k, b in PREFIXES.items() if k != "default"}, PREFIXES["default"])


NAME = "CASE p_partkey % 4 WHEN 0 THEN 'stack/layers/block/self_attn/' || lower(p_brand) || '/kernel' WHEN 1 THEN 'engrams_' || p_size || '/embedding' WHEN 2 THEN 'embedding/embedding' ELSE 'layer' || p_size || '.' || lower(p_brand) END"


@query(rf"""WITH n AS (SELECT p_partkey, regexp_replace(regexp_replace({NAME}, '^layer\d+\.', 'attn.'), '^engrams?_?(\d+)[./]?', 'engram\1.') AS n FROM part),
m AS (SELECT p_partkey, regexp_replace(replace(replace(regexp_replace(n, '^stack/', ''), 'layers/block/self_attn/', 'attn.'), 'mtp_block/self_attn/', 'mtp.'), '/kernel$', '') AS n FROM n)
SELECT p_partkey, replace(regexp_replace(CASE WHEN n = 'embedding/embedding' THEN 'embedding' ELSE n END, '^(engram\d+\.)embedding$', '\1tables'), '/', '.') AS name FROM m""")
def canonical_name(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", q.canonical_name(F.expr(NAME)).alias("name"))


@query("""WITH m AS (SELECT p_brand, p_size * 128 AS n, CASE WHEN p_type LIKE 'ECONOMY%' THEN 2 ELSE 4 END AS bits, p_partkey % 3 > 0 AS quantized FROM part)
SELECT p_brand, CAST(sum(CASE WHEN quantized THEN n * bits / 8.0 + (n // 128) * 2 ELSE n * 2 END) AS DOUBLE) AS n_bytes,
  round(sum(CASE WHEN quantized THEN n * bits END) / greatest(sum(CASE WHEN quantized THEN n ELSE 0 END), 1), 6) AS mean_bits FROM m GROUP BY p_brand""")
def size_summary(spark, sf):
    """Stored bytes and mean width of tensors, some quantized and some not."""
    p = table(spark, sf, "part").select("p_brand", (F.col("p_size") * 128).alias("n"), F.when(F.col("p_type").startswith("ECONOMY"), 2).otherwise(4).alias("bits"), (F.col("p_partkey") % 3 > 0).alias("quantized"))
    stored, bits = q.size_summary("n", "bits", "quantized", 128)
    return p.groupBy("p_brand").agg(stored.alias("n_bytes"), F.round(bits, 6).alias("mean_bits"))

"""Registered queries over the dataset operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import dataset as d


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered():
    """(queries, SQL, decorator): the decorator registers a query under its function's name, with its SQL if there is any."""
    queries, texts = {}, {}

    def query(sql: str | None):
        def add(fn):
            queries[fn.__name__] = fn
            if sql:
                texts[fn.__name__] = sql
            return fn

        return add

    return queries, texts, query


QUERIES, SQL, query = registered()


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_exists(props, '$.k')""")
def jsonl_require_key(spark, sf):
    """Rows of JSON lines that have the key."""
    rows = table(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return rows.filter(F.col("p.k").isNotNull()).select("event_id", "p.k")


@query(r"""SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))""")
def dedup_first_wins(spark, sf):
    """Only 48 bytes a row are shuffled: two hashes of 64 bits and the length stand for the text."""
    key = d.dedup_key(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", F.xxhash64(key).alias("h"), F.xxhash64(F.lit("again"), key).alias("g"), F.octet_length(key).alias("n"))
    return d.first_wins(rows, ["h", "g", "n"], ["doc_id"], ["doc_id"]).select("doc_id", "copies")


@query("""SELECT source, arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS copies FROM documents GROUP BY source""")
def catalogue_first_wins(spark, sf):
    return d.first_wins(table(spark, sf, "documents").filter("source is not null and source != ''"), ["source"], ["doc_id"], ["doc_id", "lang"]).select("source", "doc_id", "lang", "copies")


NOISY = """'Sure: [{"query":"' || event_type || '","answers":[' || user_id || ']},{"query":"only"},{"answers":null,"query":null},' || props || ',7' || CASE WHEN event_id % 5 = 0 THEN '}' ELSE '] done' END"""


@query(f"""
WITH e AS (SELECT event_id, regexp_extract({NOISY}, '(?s)\\[.*\\]') AS a FROM events),
x AS (SELECT event_id, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS pos, a FROM e WHERE json_valid(a)),
y AS (SELECT event_id, CAST(pos AS INTEGER) AS pos, json_extract(a, '$[' || pos || ']') AS item FROM x)
SELECT event_id, pos, json_extract_string(item, '$.query') AS query,
  CASE WHEN json_type(item, '$.answers') = 'NULL' THEN 'null' ELSE CAST(json_extract(item, '$.answers') AS VARCHAR) END AS answers
FROM y WHERE json_type(item) = 'OBJECT' AND json_exists(item, '$.query') AND json_exists(item, '$.answers')""")
def salvage_array(spark, sf):
    """Arrays cut out of noisy text, and the objects in them that are examples."""
    rows = table(spark, sf, "events").select("event_id", F.expr(NOISY).alias("t"))
    return d.salvaged_examples(rows, "t", ["event_id"])


@query("""
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns,
  md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn)) AS rendered_md5
FROM conversations GROUP BY conv_id""")
def render_chat(spark, sf):
    return d.render_chat(table(spark, sf, "conversations")).select("conv_id", "n_turns", F.md5("rendered").alias("rendered_md5"))


@query("""
SELECT conv_id, turn,
  md5(CASE WHEN role = 'system' THEN '<|im_start|>system' || chr(10) || role || '<|im_end|>' || chr(10) ELSE '' END
    || '<|im_start|>user' || chr(10) || '<tools>[]</tools>' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt_md5,
  md5('<think>' || role || '</think>' || chr(10) || '<tool_call>[' || turn || ']</tool_call><|im_end|>') AS target_md5
FROM conversations""")
def render_example(spark, sf):
    """Prompt and target of an example with and without a system turn."""
    c = table(spark, sf, "conversations")
    prompt = d.render_prompt(F.when(F.col("role") == "system", F.col("role")), F.lit(None).cast("string"), F.col("text"))
    target = d.render_target(F.col("role"), F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]")))
    return c.select("conv_id", "turn", F.md5(prompt).alias("prompt_md5"), F.md5(target).alias("target_md5"))


@query("""SELECT doc_id, CASE WHEN n_chars <= 128 THEN 128 WHEN n_chars <= 256 THEN 256 WHEN n_chars <= 512 THEN 512 ELSE 1024 END AS bucket FROM documents""")
def length_bucket(spark, sf):
    return table(spark, sf, "documents").select("doc_id", d.length_bucket(F.col("n_chars"), 1024).alias("bucket"))


@query("""SELECT lang, CAST(least(4096, 128 * pow(2, ceil(log2(greatest(least(max(n_chars) + 2, 4096), 128) / 128.0)))) AS INTEGER) AS max_len FROM documents GROUP BY lang""")
def fit_max_len(spark, sf):
    """The one width that holds the longest example, by language."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.max("n_chars").alias("m")).select("lang", d.length_bucket(F.col("m") + 2, 4096).alias("max_len"))


@query("""
WITH t AS (SELECT conv_id, turn, list_transform(string_split(role, ''), lambda c: unicode(c)) AS p, list_transform(string_split(text, ''), lambda c: unicode(c)) AS g FROM conversations),
x AS (SELECT conv_id, turn, ([2] || p || g || [1])[1:256] AS ids, greatest(0, least(256, len(p) + len(g) + 2) - len(p) - 1) AS m FROM t)
SELECT conv_id, turn, CAST(list_sum(ids) AS BIGINT) AS sum_ids, CAST(m AS BIGINT) AS sum_mask, CAST(256 - len(ids) AS INTEGER) AS n_pad FROM x""")
def truncate_pad_mask(spark, sf):
    c = table(spark, sf, "conversations")
    ids, mask = d.encode_and_mask(d.code_points(F.col("role")), d.code_points(F.col("text")), 256)
    rows = c.select("conv_id", "turn", ids.alias("ids"), mask.alias("mask"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select("conv_id", "turn", total("ids").alias("sum_ids"), total("mask").alias("sum_mask"), F.size(F.filter("ids", lambda x: x == d.PAD)).alias("n_pad"))


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':0'), doc_id) <= least(count(*) OVER () // 10, count(*) OVER () - 1) THEN 1 ELSE 0 END AS is_val FROM documents""")
def holdout_split(spark, sf):
    return d.holdout(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("""
SELECT doc_id, (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':1'), doc_id) - 1) // 16 AS step,
  (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':1'), doc_id) - 1) % 16 AS slot FROM documents""")
def batch_assign(spark, sf):
    return d.batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 16, "1")


@query("""SELECT 'seed' AS origin, item_id AS id, md5(text) AS text_md5 FROM benchmark UNION ALL SELECT 'generated', doc_id, md5(text) FROM documents""")
def union_augment(spark, sf):
    """Originals and generated rows together, not deduplicated against each other."""
    a = table(spark, sf, "benchmark").select(F.lit("seed").alias("origin"), F.col("item_id").alias("id"), F.md5("text").alias("text_md5"))
    return a.unionByName(table(spark, sf, "documents").select(F.lit("generated").alias("origin"), F.col("doc_id").alias("id"), F.md5("text").alias("text_md5")))


@query("""
WITH s AS (SELECT c_custkey, c_mktsegment || '//' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '/dir/' || c_name || '_step_' || c_custkey || '.bin' ELSE '/' END AS spec FROM customer),
p AS (SELECT c_custkey, spec, list_filter(string_split(spec, '/'), lambda x: x <> '') AS parts FROM s)
SELECT c_custkey, array_to_string(parts[1:2], '/') AS repo, nullif(array_to_string(parts[3:], '/'), '') AS file,
  regexp_replace(regexp_replace(regexp_extract(spec, '([^/]*)$', 1), '\\.[^.]*$', ''), '_step_[0-9]+$', '') || '_conf' AS head FROM p""".replace("\\\\", "\\"))
def spec_parse(spark, sf):
    c = table(spark, sf, "customer")
    tail = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/dir/"), "c_name", F.lit("_step_"), F.col("c_custkey").cast("string"), F.lit(".bin"))).otherwise("/")
    spec = c.select("c_custkey", F.concat("c_mktsegment", F.lit("//"), F.col("c_nationkey").cast("string"), tail).alias("spec"))
    repo, file = d.weights_spec(F.col("spec"))
    return spec.select("c_custkey", repo.alias("repo"), file.alias("file"), d.head_name(F.col("spec"), "conf").alias("head"))


@query("""
WITH h AS (SELECT *, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(event_type = 'view' AS INTEGER) END AS noisy FROM events),
r AS (SELECT event_id, user_id, last_value(noisy IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM h)
SELECT event_id, user_id FROM r WHERE coalesce(n, 0) = 0""")
def log_block_filter(spark, sf):
    """Events as log lines: blocks that a noisy header opens go."""
    return d.drop_noisy_blocks(table(spark, sf, "events"), "user_id", "event_id", "event_type", "^(click|view|purchase)$", "^view$").select("event_id", "user_id")

"""Registered queries over schemas, constraints, retrieval, gates and loops, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.cluster import settle
from quillframe.functions import schema as s
from quillframe.functions import vectors as v
from quillframe.operators import agent as a
from quillframe.operators import generation as g
from quillframe.operators import training as t
from quillframe.plans.dataset import registered, table
from quillframe.plans.kernels import X, vectors

QUERIES, SQL, query = registered()


PART = {"properties": {"p_size": {"type": "integer", "minimum": 5, "exclusiveMaximum": 45, "multipleOf": 3}, "p_name": {"type": "string", "minLength": 8, "maxLength": 30, "pattern": "[a-m]"}, "p_brand": {"type": "string", "enum": ["Brand#1", "Brand#2", "Brand#3"]}, "p_retailprice": {"type": "number", "exclusiveMinimum": 901, "maximum": 1800}}, "required": ["p_name"]}


@query("""
SELECT p_partkey, array_to_string(list_sort(list_filter([
  CASE WHEN p_size < 5 THEN 'p_size.minimum' END, CASE WHEN p_size >= 45 THEN 'p_size.exclusiveMaximum' END, CASE WHEN p_size % 3 <> 0 THEN 'p_size.multipleOf' END,
  CASE WHEN length(p_name) < 8 THEN 'p_name.minLength' END, CASE WHEN length(p_name) > 30 THEN 'p_name.maxLength' END, CASE WHEN NOT regexp_matches(p_name, '[a-m]') THEN 'p_name.pattern' END,
  CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'p_brand.enum' END,
  CASE WHEN p_retailprice <= 901 THEN 'p_retailprice.exclusiveMinimum' END, CASE WHEN p_retailprice > 1800 THEN 'p_retailprice.maximum' END], lambda x: x IS NOT NULL)), ',') AS broken FROM part""")
def constraint_check(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(s.violations({k: F.col(k) for k in PART["properties"]}, PART), ",").alias("broken"))


@query("""SELECT CAST(sum(CASE WHEN l_quantity < 1 OR l_quantity > 50 THEN 1 ELSE 0 END) AS BIGINT) AS quantity, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS discount,
  CAST(sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS BIGINT) AS flag FROM lineitem""")
def constraint_counts(spark, sf):
    """How often each rule is broken, in one pass."""
    x = table(spark, sf, "lineitem")
    q = s.rules(F.col("l_quantity"), {"minimum": 1, "maximum": 50})
    d, f = s.rules(F.col("l_discount"), {"maximum": 0.05})["maximum"], s.rules(F.col("l_returnflag"), {"const": "N"})["const"]
    n = lambda c, name: F.sum(c.cast("bigint")).alias(name)
    return x.agg(n(q["minimum"] | q["maximum"], "quantity"), n(d, "discount"), n(f, "flag"))


@query(f"""WITH a AS ({X}), m AS (SELECT label, list(u ORDER BY j) AS c FROM (SELECT label, j, avg(x) AS u FROM (SELECT label, unnest(x) AS x, unnest(range(64)) AS j FROM a) GROUP BY label, j) GROUP BY label),
t AS (SELECT label AS tool, list_transform(c, lambda e: e / sqrt(list_sum(list_transform(c, lambda f: f * f)) + 1e-12)) AS e FROM m),
q AS (SELECT vec_id AS id, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda f: f * f)) + 1e-12)) AS q FROM a),
s AS (SELECT id, tool, round(list_dot_product(q, e), 6) AS score FROM q, t)
SELECT * FROM (SELECT id, tool, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, tool) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def topk_retrieval(spark, sf):
    """The five labels, as a catalogue of mean vectors, that fit each vector best."""
    x = vectors(spark, sf)
    mean = t.element_mean(x, "label", "x").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("j", "mean"))).alias("m"))
    tools = settle(mean.select(F.col("label").alias("tool"), v.unit(F.col("m.mean")).alias("e")), "catalogue")
    return a.retrieve(x.select(F.col("vec_id").alias("id"), v.unit(F.col("x")).alias("q")), tools)


@query("""
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id), o AS (SELECT doc_id AS k, CAST(q AS VARCHAR) AS p FROM l), n AS (SELECT item_id AS k, '1' AS p FROM benchmark UNION ALL SELECT doc_id + 1000000, lang FROM documents)
SELECT coalesce(o.k, n.k) AS tool, CASE WHEN n.k IS NULL THEN 'drop' WHEN o.p = n.p THEN 'keep' ELSE 'embed' END AS action FROM o FULL JOIN n ON o.k = n.k""")
def index_refresh(spark, sf):
    """Between an index (of the labels) and another catalogue (of benchmark items and documents): what to keep, embed and drop."""
    old = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("tool")).agg(F.max("quality").cast("string").alias("p"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("tool"), F.lit("1").alias("p"))
    new = items.unionByName(table(spark, sf, "documents").select((F.col("doc_id") + 1000000).alias("tool"), F.col("lang").alias("p")))
    return a.refresh(old.select("tool", a.fingerprint(F.col("p")).alias("print")), new.select("tool", a.fingerprint(F.col("p")).alias("print")))


@query(f"""WITH a AS ({X}), e AS (SELECT vec_id, x, list_transform(x, lambda f: exp(4 * (f - list_max(x)))) AS e FROM a), l AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id)
SELECT vec_id, CASE WHEN quality IS NOT NULL AND least(1 / (1 + exp(-4 * list_max(x))), 20 * list_max(e) / list_sum(e) * quality) >= 0.6 THEN 'accept' ELSE 'escalate' END AS decision
FROM e LEFT JOIN l ON vec_id = doc_id""")
def confidence_gate(spark, sf):
    rows = vectors(spark, sf).join(table(spark, sf, "labels").groupBy(F.col("doc_id").alias("vec_id")).agg(F.min("quality").alias("quality")), "vec_id", "left")
    head = v.sigmoid(4.0 * F.array_max("x"))
    decoded = 20.0 * F.array_max(v.softmax(F.transform("x", lambda e: 4.0 * e))) * F.col("quality")
    return rows.select("vec_id", a.gate(head, decoded, 0.6).alias("decision"))


@query("""
SELECT doc_id, array_to_string(list_filter(['lang', 'source', 'first', 'loud'], lambda k: contains(lower(text), lower(CASE k WHEN 'lang' THEN lang WHEN 'source' THEN source WHEN 'first' THEN left(text, 5) ELSE upper(left(text, 3)) || '!!' END))), ',') AS kept FROM documents""")
def grounding_filter(spark, sf):
    """Arguments that the evidence doesn't hold are dropped."""
    args = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("first"), F.substring("text", 1, 5), F.lit("loud"), F.concat(F.upper(F.substring("text", 1, 3)), F.lit("!!")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.map_keys(a.grounded(args, F.col("text"))), ",").alias("kept"))


@query(r"""
SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html[^>]*lang="([a-z]+)"', 1) AS lang, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages""")
def extract_record(spark, sf):
    """A record with checked types out of each page."""
    schema = {"parameters": {"type": "object", "properties": {"title": {"type": "string", "minLength": 1}, "lang": {"type": "string", "enum": ["en", "de", "fr", "es"]}, "host": {"type": "string"}}, "required": ["title"]}}
    agent = a.Agent({}, lambda df: df, [schema])
    found = F.struct(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html[^>]*lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"))
    rows = table(spark, sf, "pages").select("page_id", F.to_json(found).alias("arguments"))
    return agent.extract(rows, "arguments").select("page_id", "record.title", "record.lang", "record.host")


@query("""
WITH RECURSIVE r(conv_id, plan, step, results) AS (
  SELECT conv_id, p, 0, '' FROM (SELECT conv_id, list(role ORDER BY turn) AS p FROM conversations GROUP BY conv_id)
  UNION ALL
  SELECT conv_id, plan, step + 1, results || CASE WHEN plan[step + 1] = 'system' THEN '{"error":"unknown tool: system"}' ELSE plan[step + 1] || ':' || step END || ';'
  FROM r WHERE step < 4 AND step < len(plan))
SELECT conv_id, max(step) AS steps, arg_max(results, step) AS results, CASE WHEN max(len(plan)) > 4 THEN 'call' ELSE 'respond' END AS type FROM r GROUP BY conv_id""")
def bounded_loop(spark, sf):
    """Calls planned by the roles of a conversation, four steps at most; "system" is a tool that nobody declared."""

    def propose(df):
        name = F.get("plan", F.col("steps"))
        return df.withColumn("call", F.when(name.isNotNull(), F.struct(name.alias("name"), F.col("steps").cast("string").alias("argument"))))

    agent = a.Agent({r: (lambda x, r=r: F.concat(F.lit(r + ":"), x)) for r in ("user", "assistant")}, propose, max_steps=4)
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    rows = agent.run(c.select("conv_id", F.col("t.role").alias("plan"), F.lit("go").alias("q")), "q")
    return rows.select("conv_id", "steps", F.concat_ws("", F.transform("results", lambda x: F.concat(x, F.lit(";")))).alias("results"), "type")


def _reply(request: int, prompt: str) -> str:
    """A deterministic stand-in for a model: 25 numbered examples in noisy text, every tenth request failing, numbers repeating after 700."""
    if request % 10 == 9:
        raise RuntimeError("no reply")
    items = [f'{{"query": " Item {(request * 25 + k) % 700}", "answers": [{{"name": "f", "arguments": {{"n": {(request * 25 + k) % 700 % 7}}}}}]}}' for k in range(25)]
    return f"Here you are: [{', '.join(items)}] - done"


@query("""WITH r AS (SELECT unnest(range(120)) AS request), k AS (SELECT request, unnest(range(25)) AS pos FROM r WHERE request % 10 <> 9),
x AS (SELECT request, pos, (request * 25 + pos) % 700 AS n FROM k), f AS (SELECT n, min((request, pos)) AS first FROM x GROUP BY n)
SELECT CAST(first[1] AS BIGINT) AS request, CAST(first[2] AS INTEGER) AS pos, ' Item ' || n AS query, '[{"arguments":{"n":' || n % 7 || '},"name":"f"}]' AS answers
FROM f ORDER BY first LIMIT 600""")
def overgenerate(spark, sf):
    """600 distinct examples from a generator that repeats itself and fails now and then."""
    return g.generate_dataset(spark, _reply, [{"name": "f"}], 600, width=16).select("request", "pos", "query", "answers")


@query("""WITH r AS (SELECT unnest(range(36)) AS request), k AS (SELECT request, unnest(range(25)) AS pos FROM r WHERE request % 10 <> 9)
SELECT CAST(count(DISTINCT (request * 25 + pos) % 700) AS BIGINT) AS n, CAST(35 AS BIGINT) AS last FROM k""".replace("range(36)", "range(117)").replace("CAST(35 AS BIGINT) AS last", "true AS bounded"))
def overgenerate_bounded(spark, sf):
    """A target that the generator can't reach: all there is, after a bounded number of requests."""
    rows = g.generate_dataset(spark, _reply, "[]", 1000, width=16)
    most = g.requests_for(1000, 25, 16)[1]
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.max("request") < most).alias("bounded"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN '{"error": "system"}' ELSE '{"n": ' || length(text) || '}' END AS result FROM conversations""")
def python_tools(spark, sf):
    """A Python tool run on every turn by its JSON arguments; what it raises is its result."""

    def measure(text: str, role: str = "user"):
        "Length of a text."
        if role == "system":
            raise ValueError(role)
        return {"n": len(text)}

    agent = a.Agent.with_python_tools([measure], lambda df: df)
    c = table(spark, sf, "conversations")
    call = F.struct(F.lit("measure").alias("name"), F.to_json(F.struct("text", "role")).alias("argument"))
    return c.select("conv_id", "turn", agent.execute(call).alias("result"))

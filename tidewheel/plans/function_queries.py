"""JSON, maps, ids, clocks, random numbers and texts beyond the first catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import clock, hashing, jsonx, maps, rng, slots
from tidewheel.model import decode_node, encode_node, provider_text
from tidewheel.operators import graph, reduce, schedule
from tidewheel.plans.history_queries import _STEPS, _steps
from tidewheel.plans.registry import query, table
from tidewheel.sources import history
from tidewheel.streaming import events as ev


@query("""SELECT event_id, (event_id % 5)::VARCHAR AS key_0, CASE WHEN event_id % 2 = 0 THEN 'x' END AS item, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '7' ELSE 'none' END AS deep,
CASE WHEN event_id % 3 < 2 THEN true ELSE false END AS has_deep FROM events""")
def json_digits(spark, sf_dir):
    """Digits name a place of a list or a key of an object; a JSON null is there, and is not the default."""
    k = F.col("event_id")
    d = F.concat(F.lit('{"o":{"0":'), (k % 5).cast("string"), F.lit('},"l":['), F.when(k % 2 == 0, '"x"').otherwise(""), F.lit('],"d":'), F.when(k % 3 == 0, '{"e":null}').when(k % 3 == 1, '{"e":7}').otherwise("{}"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", jsonx.get_path(d, "o.0").alias("key_0"), jsonx.get_path(d, "l.0").alias("item"), jsonx.path_or(d, "d.e", F.lit("none")).alias("deep"), jsonx.has_path(d, "d.e").alias("has_deep"))


@query("""SELECT event_id, '{"a":' || event_id % 7 || ',"b":' || CASE WHEN event_id % 2 = 0 THEN '2' ELSE '1' END || ',"c":3}' AS merged, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS empty,
CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'k,z' ELSE '' END AS keys, '{"v":{"k":' || event_id % 7 || '}}' AS set_to, '{"m":' || event_id % 7 || '}' AS mapped, (event_id % 7)::BIGINT AS back FROM events""")
def json_more(spark, sf_dir):
    """Merging many documents, emptiness, keys, setting, maps, and text there and back."""
    k = F.col("event_id")
    n = (k % 7).cast("string")
    docs = F.array(F.concat(F.lit('{"a":'), n, F.lit(',"b":1}')), F.when(k % 2 == 0, '{"b":2}').otherwise("{}"), F.lit('{"c":3}'))
    sample = F.when(k % 4 == 0, "{}").when(k % 4 == 1, '{"z":1,"k":[]}').when(k % 4 == 2, "[]").otherwise("5")
    m = F.create_map(F.lit("m"), k % 7)
    text = jsonx.serialised(F.struct((k % 7).alias("x")), "x")
    return table(spark, sf_dir, "events").select(
        "event_id", jsonx.merge_many(docs, "prefer_right").alias("merged"), jsonx.is_empty(sample).alias("empty"), F.array_join(jsonx.keys(sample), ",").alias("keys"),
        jsonx.set_path(F.lit("{}"), "v.k", n).alias("set_to"), jsonx.map_to_json(m).alias("mapped"), jsonx.deserialised(text, "x bigint", "x")["x"].alias("back"))


@query("""SELECT event_id, 'b' AS last_of_pairs, CASE WHEN event_id % 2 = 0 THEN event_id END AS got, -1::BIGINT AS gone, (CASE WHEN event_id % 2 = 0 THEN event_id + 1 ELSE 10 END)::BIGINT AS updated, '"x"' AS text_value, '5' AS number_value FROM events""")
def map_helpers(spark, sf_dir):
    """k is stored for all, as null for odd ids; u is there for even ids only."""
    k = F.col("event_id")
    m = F.create_map(F.lit("k"), F.when(k % 2 == 0, k))
    u = F.when(k % 2 == 0, F.create_map(F.lit("u"), k)).otherwise(F.create_map(F.lit("v"), k))
    pairs = maps.from_pairs(F.array(F.struct(F.lit("p").alias("key"), F.lit("a").alias("value")), F.struct(F.lit("p").alias("key"), F.lit("b").alias("value"))))
    blank = F.create_map(F.lit("z"), F.lit("1"))
    return table(spark, sf_dir, "events").select(
        "event_id", pairs["p"].alias("last_of_pairs"), maps.get_or(m, F.lit("k"), F.lit(-1)).alias("got"), maps.get_or(m, F.lit("nope"), F.lit(-1).cast("bigint")).alias("gone"),
        maps.insert_or_update(u, F.lit("u"), F.lit(10).cast("bigint"), lambda v: v + 1)["u"].alias("updated"), maps.put_typed(blank, F.lit("t"), F.lit("x"))["t"].alias("text_value"), maps.put_typed(blank, F.lit("t"), F.lit(5))["t"].alias("number_value"))


@query("""SELECT user_id AS session_id, string_agg(event_type, ',' ORDER BY event_type) AS keys FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type NOT IN ('view', 'click')) GROUP BY 1""")
def map_clear(spark, sf_dir):
    """Clearing keys writes nulls, which the map's reducer drops; what is left, in order of keys."""
    x = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("key"), F.lit("1").alias("value")).distinct()
    gone = maps.clear_keys(x.select("session_id").distinct(), ["view", "click"]).withColumn("run_ord", F.lit(0))
    left = reduce.merge_map(x, gone)
    return left.groupBy(F.col("session_id").cast("bigint").alias("session_id")).agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'run-counter-' || o_orderkey WHEN 1 THEN 'node-seeded-9' WHEN 2 THEN 'p-seeded-9-' || o_orderkey || '-t1700000000' ELSE 'plain' END AS id, o_orderkey % 4 <> 3 AS valid, o_orderkey % 4 = 0 AS is_run,
CASE o_orderkey % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'node' WHEN 2 THEN 'p' ELSE 'plain' END AS kind, CASE WHEN o_orderkey % 4 = 2 THEN 1700000000 END::BIGINT AS stamp, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'seeded-9' WHEN o_orderkey % 4 = 0 THEN 'counter-' || o_orderkey ELSE 'seeded-9-' || o_orderkey || '-t1700000000' END AS rest FROM orders""")
def id_forms(spark, sf_dir):
    k = F.col("o_orderkey")
    made = F.when(k % 4 == 0, hashing.kind_id("run", k, counter=True)).when(k % 4 == 1, hashing.kind_id("node", k, seed=9)).when(k % 4 == 2, hashing.generated_id(k, "p", 9, True, F.lit(1_700_000_000))).otherwise("plain")
    o = table(spark, sf_dir, "orders").select("o_orderkey", made.alias("id"))
    _, rest, stamp = hashing.parse_id(F.col("id"))
    return o.select("o_orderkey", "id", hashing.is_valid_id(F.col("id")).alias("valid"), hashing.is_valid_id(F.col("id"), "run").alias("is_run"), hashing.id_type(F.col("id")).alias("kind"), stamp.alias("stamp"), rest.alias("rest"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Start' WHEN 1 THEN 'Custom:' || p_brand ELSE 'Custom:Custom:' || p_brand END AS stored, CASE p_partkey % 3 WHEN 0 THEN 'Start' WHEN 1 THEN p_brand ELSE 'Custom:' || p_brand END AS name FROM part""")
def node_codec(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "Start").when(k % 3 == 1, F.col("p_brand")).otherwise(F.concat(F.lit("Custom:"), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", encode_node(name).alias("stored"), decode_node(encode_node(name)).alias("name"))


_M = "md5('42:' || {d} || ':' || o_orderkey)"


@query(f"""SELECT o_orderkey, ('0x' || substr({_M.format(d=0)}, 1, 16))::UBIGINT::VARCHAR AS u64, ('0x' || substr({_M.format(d=1)}, 1, 8))::BIGINT AS u32, ('0x' || substr({_M.format(d=2)}, 1, 8))::BIGINT % 2 = 1 AS flag,
('0x' || substr({_M.format(d=3)}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS f64, 10 + ('0x' || substr({_M.format(d=4)}, 1, 8))::BIGINT % 90 AS range_, 5::BIGINT AS nothing, ['x', 'y', 'z'][1 + ('0x' || substr({_M.format(d=5)}, 1, 8))::BIGINT % 3] AS chosen,
chr((97 + ('0x' || substr(md5('42:6:' || o_orderkey || ':0'), 1, 8))::BIGINT % 26)::INT) || chr((97 + ('0x' || substr(md5('42:6:' || o_orderkey || ':1'), 1, 8))::BIGINT % 26)::INT) AS letters,
substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', 1 + (('0x' || substr(md5('42:7:' || o_orderkey || ':0'), 1, 8))::BIGINT % 62), 1) AS sign,
('0x' || substr(md5(('0x' || substr({_M.format(d=0)}, 1, 16))::UBIGINT || ':0:' || o_orderkey), 1, 8))::BIGINT AS forked, true AS reset_same FROM orders""")
def rng_draws(spark, sf_dir):
    """One draw of each kind; forks and resets."""
    r = [rng.Seeded.of(42, F.col("o_orderkey"))]
    for _ in range(7):
        r.append(r[-1].next())
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", r[0].u64().cast("string").alias("u64"), r[1].u32().alias("u32"), r[2].bool_().alias("flag"), r[3].f64().alias("f64"), r[4].range_(10, 100).alias("range_"), r[4].range_(5, 5).alias("nothing"),
        r[5].choose(F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("chosen"), r[6].string(2).alias("letters"), r[7].alphanumeric(1).alias("sign"), r[0].fork().u32().alias("forked"), (r[7].reset().u64() == r[0].u64()).alias("reset_same"))


@query("""SELECT n_nationkey, ('0x' || substr(md5('3105:0:' || n_nationkey), 1, 8))::BIGINT AS first, ('0x' || substr(md5('3105:1:' || n_nationkey), 1, 8))::BIGINT AS second, 1 AS names FROM nation""")
def rng_named(spark, sf_dir):
    """Seed of the name ab over base 0: 97 * 31 + 98."""
    r = rng.Registry(0)
    key = F.col("n_nationkey")
    first = r.named("ab", key).u32()
    r.advance("ab")
    second = r.named("ab", key).u32()
    r.reset_all()
    return table(spark, sf_dir, "nation").select("n_nationkey", first.alias("first"), second.alias("second"), F.lit(len(r)).alias("names"))


@query("""SELECT event_id, 1705363202000::BIGINT AS now_ms, greatest(1705363202 - floor(epoch(ts))::BIGINT, 0) AS age FROM events""")
def clock_mock(spark, sf_dir):
    c = clock.MockClock(1_705_363_200).advance(2.9)
    return table(spark, sf_dir, "events").select("event_id", c.milliseconds().alias("now_ms"), clock.since(c.now(), F.col("ts")).alias("age"))


@query("""SELECT event_id, chr(27) || '[31m1. [app] bad' || chr(27) || '[0m' || chr(10) || '  ' || chr(27) || '[33mcause: why' || chr(27) || '[0m' || CASE WHEN event_id % 2 = 0 THEN chr(10) || '  context: {"u":' || user_id || '}' ELSE '' END AS coloured, '1. [app] bad' AS plain FROM events WHERE event_type = 'error'""")
def error_pretty(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    none = F.array().cast("array<string>")
    context = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"u":'), F.col("user_id").cast("string"), F.lit("}"))).otherwise("{}")
    one, scope, bad = F.lit(1), F.lit("app"), F.lit("bad")
    return e.select("event_id", slots.error_text(one, scope, bad, F.array(F.lit("why")), none, context, "auto", True).alias("coloured"), slots.error_text(one, scope, bad, none, none, colour="auto").alias("plain"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN '[tool call: ' || role || ']' ELSE '' END AS answer FROM conversations""")
def provider_answers(spark, sf_dir):
    """A first text part is kept, a tool call without text becomes a marker."""
    t = F.col("turn")
    part = lambda kind, text, name: F.struct(F.lit(kind).alias("kind"), text.alias("text"), name.alias("name"))
    none = F.lit(None).cast("string")
    call, text = part("tool_call", none, F.col("role")), part("text", F.col("role"), none)
    parts = F.when(t % 3 == 0, F.array(call, text)).when(t % 3 == 1, F.array(call)).otherwise(F.array().cast("array<struct<kind:string,text:string,name:string>>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", provider_text(parts).alias("answer"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'found' WHEN 1 THEN 'missing' ELSE 'undecodable' END AS status, (props->>'$.k')::DOUBLE AS number, NULL::VARCHAR AS problem_number, 'wrong type' AS problem_text, 'missing' AS problem_gone FROM events""")
def slot_status(spark, sf_dir):
    k = F.col("event_id")
    stored = F.when(k % 3 == 0, '{"cash":5}').when(k % 3 == 2, "not json")
    p = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id", slots.status(stored, "cash bigint").alias("status"), slots.typed_get(p, "k", "number")["value"].alias("number"), slots.typed_get(p, "k", "number")["problem"].alias("problem_number"),
        slots.typed_get(p, "k", "string")["problem"].alias("problem_text"), slots.typed_get(p, "gone", "string")["problem"].alias("problem_gone"))


@query("""SELECT event_type AS type, count(*) AS n FROM events WHERE event_type IN ('view', 'error') AND user_id % 2 = 0 GROUP BY 1""")
def event_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("scope"))
    return ev.only(e, kinds=["view", "error"], scopes=["even"]).groupBy("type").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_returnflag AS node, l_quantity AS v FROM lineitem WHERE l_quantity >= 5), b AS (SELECT unnest([1.0, 5, 10, 50, 100, 500, 1000, NULL])::DOUBLE AS le)
SELECT node, le, count(CASE WHEN le IS NULL OR v <= le THEN 1 END) AS n FROM l, b GROUP BY 1, 2""")
def metrics_histogram(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("node"), F.when(F.col("l_quantity") >= 5, F.col("l_quantity")).alias("ms"))
    return ev.histogram(r, ["node"], "ms")


@query("""SELECT user_id AS session_id, event_type AS key, arg_max(event_id, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def extra_fold(spark, sf_dir):
    """Later maps win; nothing is deleted."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), F.col("event_id").alias("value"), "ts")
    return reduce.fold_maps(e.withColumn("at", F.struct("ts", "value")), ["session_id", "key"], ["at"])


@query("""SELECT p_brand AS session_id, p_partkey::VARCHAR AS node, c.cmd_pos, c.kind FROM part, (VALUES (0, 'append'), (1, 'replace'), (2, 'replace'), (3, 'append')) c(cmd_pos, kind)
WHERE (p_size % 2 = 0 AND cmd_pos IN (1, 3)) OR (p_size % 2 = 1 AND kind = 'append')""")
def commands_first_replace(spark, sf_dir):
    """A second Replace is ignored, as is an Append before the first; without Replace all Appends count."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("session_id"), F.col("p_partkey").cast("string").alias("node"), "p_size")
    given = F.array(*(F.struct(F.lit(k).alias("cmd_pos"), F.lit(n).alias("kind")) for k, n in enumerate(("append", "replace", "replace", "append"))))
    c = p.select("session_id", "node", "p_size", F.inline(given)).where("p_size % 2 = 0 or kind = 'append'")
    return schedule.commands_in_force(c).select("session_id", "node", "cmd_pos", "kind")


@query(f"""WITH {_STEPS}, l AS (SELECT session_id, max(step) AS last_step, max(created_at) AS updated_at FROM s GROUP BY 1) SELECT s.session_id, s.step, l.last_step, s.step = l.last_step AS is_last FROM s JOIN l USING (session_id)""")
def ckpt_header(spark, sf_dir):
    """Headers whose pointer only moves forward, though later steps come in first; and the steps joined with them."""
    s = _steps(spark, sf_dir)
    late, early = s.where("step % 2 = 0"), s.where("step % 2 = 1")
    none = s.limit(0).select("session_id", F.col("step").alias("last_step"), F.col("created_at").alias("updated_at"))
    h = history.headers(history.headers(none, late), early)
    return history.with_header(s.select("session_id", "step"), h.drop("updated_at")).withColumn("is_last", F.col("step") == F.col("last_step"))


@query(f"""WITH {_STEPS} SELECT session_id, step FROM s WHERE created_at >= TIMESTAMP '1996-01-01' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY step DESC) <= 3""")
def ckpt_recent(spark, sf_dir):
    """Not older than a time, and of these the newest three."""
    return history.retain(_steps(spark, sf_dir), newest=3, since=F.lit("1996-01-01").cast("timestamp_ntz")).select("session_id", "step")


def _ring(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    e = n.select(F.concat(F.lit("n"), k.cast("string")).alias("src"), F.concat(F.lit("n"), ((k + 1) % 25).cast("string")).alias("dst"))
    return e.select(F.col("src").alias("node")), e


@query("""SELECT true AS cyclic, false AS cyclic_without, 26 AS length, 'n0' AS first, 'n0' AS last""")
def graph_witness(spark, sf_dir):
    """All nations in one ring: a closed path, and none where one edge is missing."""
    _, e = _ring(spark, sf_dir)
    path = graph.cycle_witness(e)
    return spark.createDataFrame([(graph.is_cyclic(e), graph.is_cyclic(e.where("src <> 'n3'")), len(path), path[0], path[-1])], "cyclic boolean, cyclic_without boolean, length int, first string, last string")


@query("""WITH n AS (SELECT 'n' || n_nationkey AS node FROM nation UNION ALL SELECT 'Start' UNION ALL SELECT 'End'), i AS (SELECT node, row_number() OVER (ORDER BY CASE node WHEN 'Start' THEN 0 WHEN 'End' THEN 2 ELSE 1 END, node) - 1 AS k FROM n),
e AS (SELECT 'n' || n_nationkey AS src, 'n' || ((n_nationkey + 1) % 25) AS dst FROM nation UNION ALL SELECT 'Start', 'n0' UNION ALL SELECT 'n24', 'End')
SELECT src, dst, a.k AS src_index, b.k AS dst_index FROM e JOIN i a ON a.node = src JOIN i b ON b.node = dst""")
def graph_indexed(spark, sf_dir):
    nodes, e = _ring(spark, sf_dir)
    e = e.union(spark.createDataFrame([("Start", "n0"), ("n24", "End")], "src string, dst string"))
    at, pairs = graph.to_indexed(nodes, e)
    side = lambda c: at.select(F.col("node").alias(c), F.col("index").alias(f"{c}_index"))
    return pairs.join(side("src"), "src_index").join(side("dst"), "dst_index").select("src", "dst", "src_index", "dst_index")


@query("""SELECT 'digraph {' || chr(10) || '    0 [label="Start", style=filled, fillcolor="lightgreen"]' || chr(10) || (SELECT string_agg('    ' || k || ' [label="' || r_name || '"]', chr(10) ORDER BY k) FROM (SELECT r_name, row_number() OVER (ORDER BY r_name) AS k FROM region)) || chr(10)
|| '    6 [label="End", style=filled, fillcolor="lightcoral"]' || chr(10) || '    0 -> 1' || chr(10) || '    0 -> 2' || chr(10) || '    0 -> 3' || chr(10) || '    0 -> 4' || chr(10) || '    0 -> 5' || chr(10)
|| '    1 -> 6' || chr(10) || '    2 -> 6' || chr(10) || '    3 -> 6' || chr(10) || '    4 -> 6' || chr(10) || '    5 -> 6' || chr(10) || '}' || chr(10) AS dot""")
def graph_dot(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("node"))
    e = r.select(F.lit("Start").alias("src"), F.col("node").alias("dst")).union(r.select("node", F.lit("End")))
    return spark.createDataFrame([(graph.to_dot(r, e),)], "dot string")


@query("""SELECT * FROM (SELECT 4 AS priority, 'duplicate edge' AS kind, 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1
UNION ALL SELECT 6, 'unknown source', 's' || l_suppkey, NULL FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey % 7 = 0) UNION ALL SELECT 0, 'missing entry', 'Start', NULL)""")
def graph_violations(spark, sf_dir):
    """All violations of the supply graph at once, where suppliers divisible by 7 are no nodes and no edge leaves Start."""
    li = table(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    nodes = li.where("l_suppkey % 7 <> 0").select(s.alias("node")).union(li.select(p)).distinct()
    free = spark.createDataFrame([("s1",)], "src string")
    return graph.violations(nodes, li.select(s.alias("src"), p.alias("dst")), free)


@query("""WITH p AS (SELECT n_regionkey, ['graph-v1'] || list('node:Custom:' || n_name ORDER BY 'node:Custom:' || n_name) || list('edge:Start->Custom:' || n_name ORDER BY n_name) || ['conditional:0:Custom:x', 'conditional:1:Custom:x', 'reducer:extra'] AS parts, count(*) AS n FROM nation GROUP BY 1),
b AS (SELECT n_regionkey, n, list_transform(range(0, len(hex(array_to_string(parts, chr(1)))::VARCHAR) // 2), lambda i: ('0x' || substr(hex(array_to_string(parts, chr(1))), (2 * i + 1)::INT, 2))::INT) AS bytes FROM p),
c AS (SELECT n_regionkey, n, list_concat(list_transform(bytes, lambda x: CASE WHEN x = 1 THEN 255 ELSE x END), [255]) AS bytes FROM b),
h AS (SELECT n_regionkey, n, list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(bytes, lambda x: x::HUGEINT)), lambda h, x: (((h - h % 256) + xor((h % 256)::INT, x::INT)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS hash FROM c)
SELECT n_regionkey, n AS n_nodes, n AS n_edges, 2::BIGINT AS n_conditionals, 1::BIGINT AS n_reducers, lpad(lower(printf('%x', hash::UBIGINT)), 16, '0') AS hash FROM h""")
def graph_metadata(spark, sf_dir):
    """A graph a region: nodes and edges from Start for its nations, two conditionals of one source, one reducer."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("node"))
    g = n.select("n_regionkey").distinct()
    twice = g.select("n_regionkey", F.explode(F.array(F.lit("x"), F.lit("x"))).alias("src"))
    return graph.metadata(n, n.select("n_regionkey", F.lit("Start").alias("src"), F.col("node").alias("dst")), twice, g.withColumn("label", F.lit("extra")), ["n_regionkey"])

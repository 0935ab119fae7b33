"""Events, JSON, ids, clock and plain transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.functions import clock, hashing, jsonx, slots, transforms
from tidewheel.materialize import cut, shared_dir
from tidewheel.model import display, storage_key
from tidewheel.plans.registry import query, table
from tidewheel.streaming import events as ev

_KIND = "CASE WHEN event_type = 'view' THEN 'llm' WHEN event_type = 'error' THEN 'diagnostic' ELSE 'node' END"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "llm").when(F.col("event_type") == "error", "diagnostic").otherwise("node")
    node = F.when(kind == "node", F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")))
    step = F.when((kind == "node") & (F.col("event_id") % 3 > 0), F.col("event_id") % 10)
    return e.withColumns({"kind": kind, "node_id": node, "step": step, "stream": F.when((kind == "llm") & (F.col("event_id") % 2 == 0), F.concat(F.lit("st"), (F.col("user_id") % 3).cast("string")))})


@query(f"""SELECT event_id, {_KIND} AS type, CASE {_KIND} WHEN 'llm' THEN CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'stream' ELSE 'chunk' END ELSE event_type END AS scope, event_type || '#' || event_id AS message,
CASE {_KIND} WHEN 'llm' THEN 'user' ELSE 'field' END AS clash FROM events""")
def event_envelope(spark, sf_dir):
    """The five fields of an event; of metadata with one name in fields and user data, who wins depends on the type."""
    e = _events(spark, sf_dir)
    scope = F.when(F.col("kind") == "llm", ev.llm_scope(F.lit(True), F.col("event_id") % 5 == 0, F.col("event_id") % 10 == 0)).otherwise(F.col("event_type"))
    one = lambda v: F.create_map(F.lit("k"), F.lit(v))
    x = e.select("event_id", ev.envelope(F.col("kind"), scope, F.concat("event_type", F.lit("#"), F.col("event_id").cast("string")), F.col("ts"), ev.joined_metadata(F.col("kind"), one("field"), one("user"))).alias("e"))
    return x.select("event_id", "e.type", "e.scope", "e.message", F.col("e.metadata")["k"].alias("clash"))


@query(f"""SELECT event_id, CASE {_KIND} WHEN 'llm' THEN '[LLM ' || CASE WHEN event_id % 2 = 0 THEN 'st' || (user_id % 3) ELSE 'default' END || '] ' || event_type
WHEN 'node' THEN CASE WHEN event_id % 3 > 0 THEN '[n' || (user_id % 5) || '@' || (event_id % 10) || '] ' ELSE '[n' || (user_id % 5) || '] ' END || event_type ELSE event_type END AS line FROM events""")
def event_display(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", display(F.col("kind"), F.col("node_id"), F.col("step"), F.col("stream"), F.col("event_type")).alias("line"))


@query("""SELECT event_id, coalesce((props->>'$.k'), '-') AS k, coalesce((props->>'$.missing'), 'none') AS missing, (json_keys(props))[1] AS first_key, 1 AS n_elements, true AS has_k FROM events""")
def json_path(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", jsonx.path_or(p, "k", F.lit("-")).alias("k"), jsonx.path_or(p, "missing", F.lit("none")).alias("missing"), F.json_object_keys(p)[0].alias("first_key"), jsonx.count_elements(p).alias("n_elements"), jsonx.has_keys(p, ["k"]).alias("has_k"))


@query("""WITH e AS (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events) SELECT event_id, k AS left_k, k + 1 AS right_k, event_id AS only_left, event_id % 7 AS only_right FROM e""")
def json_merge(spark, sf_dir):
    """Flat objects {k, a} and {k, b} merged with the left, and with the right winning."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    a, b = F.create_map(F.lit("k"), F.col("k"), F.lit("a"), F.col("event_id")), F.create_map(F.lit("k"), F.col("k") + 1, F.lit("b"), F.col("event_id") % 7)
    l, r = jsonx.merge_flat(a, b, "prefer_left"), jsonx.merge_flat(a, b, "prefer_right")
    return e.select("event_id", l["k"].alias("left_k"), r["k"].alias("right_k"), l["a"].alias("only_left"), r["b"].alias("only_right"))


@query("""SELECT event_id, '{"k":[' || (props->>'$.k') || ',' || (event_id % 5) || '],"o":{"x":' || (event_id % 5) || ',"y":1}}' AS merged FROM events""")
def json_deep_merge(spark, sf_dir):
    """Nested objects recurse, lists are joined."""
    e = table(spark, sf_dir, "events")
    n = (F.col("event_id") % 5).cast("string")
    a = F.concat(F.lit('{"k":['), F.get_json_object("props", "$.k"), F.lit('],"o":{"x":0,"y":1}}'))
    b = F.concat(F.lit('{"k":['), n, F.lit('],"o":{"x":'), n, F.lit("}}"))
    return e.select("event_id", jsonx.merge(a, b, "deep").alias("merged"))


@query("""SELECT user_id, count(*) AS published, least(count(*), 32) AS retained, greatest(count(*) - 32, 0) AS dropped FROM events GROUP BY 1""")
def hub_lag(spark, sf_dir):
    return ev.lag(table(spark, sf_dir, "events"), 32, "user_id")


@query("""SELECT user_id, event_id, (count(*) OVER (PARTITION BY user_id) - 32) AS dropped FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 32""")
def hub_buffer(spark, sf_dir):
    """Users have more than 32 events each, so all lag."""
    e = table(spark, sf_dir, "events")
    return ev.buffered(e, 32, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "dropped")


@query("""SELECT 'sink' || (user_id % 7) AS sink, count(*) AS n_errors, arg_max('e' || event_id, (ts, event_id)) AS last_error, max(ts) AS last_when FROM events WHERE event_type = 'error' GROUP BY 1""")
def sink_health(spark, sf_dir):
    f = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("sink"), (F.col("user_id") % 7).cast("string")).alias("sink"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"), F.col("ts").alias("when"), "event_id")
    return ev.sink_health(f, order=("when", "event_id"))


@query("""SELECT 'sink' || (user_id % 7) AS sink, event_id, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id)::INT AS occurrence FROM events WHERE event_type = 'error'""")
def sink_occurrences(spark, sf_dir):
    f = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("sink"), (F.col("user_id") % 7).cast("string")).alias("sink"), F.col("ts").alias("when"), "event_id")
    return ev.occurrences(f, order=("when", "event_id")).select("sink", "event_id", "occurrence")


@query("""SELECT l_returnflag AS node, CASE WHEN l_quantity < 5 THEN 'skipped' ELSE 'ran' END AS outcome, count(*) AS n, count(CASE WHEN l_quantity >= 5 THEN 1 END) AS n_timed, sum(CASE WHEN l_quantity >= 5 THEN round(l_extendedprice * 100)::BIGINT END)::BIGINT AS total FROM lineitem GROUP BY 1, 2""")
def metrics(spark, sf_dir):
    """Skipped nodes count but have no duration."""
    ran = F.col("l_quantity") >= 5
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("node"), F.when(ran, "ran").otherwise("skipped").alias("outcome"), F.when(ran, F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("ms"))
    return ev.metrics(r, ["node", "outcome"], "ms")


@query("""SELECT o_orderkey, 'run-seeded-42-' || o_orderkey AS id, 'run' AS prefix, 'seeded-42-' || o_orderkey AS rest, 'ns:' || lower(o_orderstatus) || ':v' || (o_orderkey % 3) AS slot FROM orders""")
def ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", hashing.seeded_id("run", 42, F.col("o_orderkey")).alias("id"), storage_key(F.lit("ns"), F.lower("o_orderstatus"), F.col("o_orderkey") % 3).alias("slot"))
    prefix, rest, _ = hashing.parse_id(F.col("id"))
    return o.select("o_orderkey", "id", prefix.alias("prefix"), rest.alias("rest"), "slot")


@query("""SELECT n_name, list_reduce(list_concat([0::HUGEINT], list_transform(string_split(n_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, x: (h * 31 + x) % 18446744073709551616::HUGEINT)::VARCHAR AS seed FROM nation""")
def name_seeds(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", hashing.name_seed(F.col("n_name")).cast("string").alias("seed"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS at, greatest(epoch(TIMESTAMP '2024-01-15 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT, 0) AS age, greatest(epoch(TIMESTAMP '2024-01-15 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT, 0) <= 86400 AS recent FROM events""")
def clock_fmt(spark, sf_dir):
    now, ts = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", clock.formatted(ts).alias("at"), clock.since(now, ts).alias("age"), clock.is_recent(now, ts, 86_400).alias("recent"))


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, reverse(p_name) AS back, p_name AS same, strlen(p_name)::INT AS bytes, 2 AS elements, (p_size * 3)::INT AS thrice, p_size::VARCHAR AS got, CASE p_brand WHEN 'Brand#1' THEN 'one' WHEN 'Brand#2' THEN 'two' ELSE 'rest' END AS route FROM part""")
def transform_rules(spark, sf_dir):
    n, size = F.col("p_name"), F.col("p_size")
    doc = F.concat(F.lit('{"a":{"b":'), size.cast("string"), F.lit("}}"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", transforms.transform("uppercase", n).alias("up"), transforms.transform("lowercase", n).alias("low"), transforms.transform("reverse", n).alias("back"), transforms.transform("nothing", n).alias("same"), transforms.length(n).alias("bytes"),
        transforms.length(F.array(n, n), True).alias("elements"), transforms.multiply(size, 3).alias("thrice"), transforms.extract(doc, "a.b").alias("got"), transforms.looked_up(F.col("p_brand"), {"Brand#1": "one", "Brand#2": "two"}, "rest").alias("route"))


@query("""SELECT user_id, 'session=' || user_id || ' status=' || CASE WHEN count(*) > 60 THEN 'done' ELSE 'failed' END || CASE WHEN count(*) % 2 = 0 THEN ' step=' || count(*) ELSE '' END AS line FROM events GROUP BY 1""")
def stream_ends(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", ev.stream_end(F.col("user_id"), F.when(F.col("n") > 60, "done").otherwise("failed"), F.when(F.col("n") % 2 == 0, F.col("n")), F.lit(None)).alias("line"))


def _stream(spark, sf_dir):
    """events.parquet alone as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _folder(spark, name):
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT event_id, user_id, event_type FROM events""")
def stream_jsonl(spark, sf_dir):
    """Events streamed through a JSON-lines sink and a failing one, and read back."""
    out, state = _folder(spark, "jsonl"), _folder(spark, "jsonl-state")

    def broken(batch, epoch):
        raise RuntimeError("this sink is broken")

    sinks = ev.Sinks().add("jsonl", ev.jsonl_sink(out)).add("broken", broken)
    q = ev.start(_stream(spark, sf_dir).select("event_id", "user_id", "event_type"), sinks, state)
    q.awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint, event_type string").json(f"{out}/epoch=*")


@query("""SELECT user_id, sum(round(value * 100)::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1""")
def stream_stateful(spark, sf_dir):
    """Iterative sessions as keyed state; the last update of each key."""
    out, state = _folder(spark, "sums"), _folder(spark, "sums-state")
    s = ev.running_sum(_stream(spark, sf_dir).select("user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents")), "user_id", "cents")
    write = lambda b, epoch: b.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
    s.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    return cut(found.groupBy("user_id").agg(F.max_by(F.struct("total", "n"), "epoch").alias("r")).select("user_id", "r.*"))


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN event_id % 4 = 0 THEN 'string' WHEN event_id % 4 = 1 THEN 'array' WHEN event_id % 4 = 2 THEN 'number' ELSE 'missing' END AS kind, true AS has_number, false AS has_text FROM events""")
def slot_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sample = F.when(F.col("event_id") % 4 == 0, '"x"').when(F.col("event_id") % 4 == 1, "[1]").when(F.col("event_id") % 4 == 2, "3")
    p = F.col("props")
    return e.select("event_id", slots.slot(p, "k bigint")["k"].alias("k"), slots.kind(sample).alias("kind"), slots.has_typed(p, "k", "number").alias("has_number"), slots.has_typed(p, "k", "string").alias("has_text"))


@query("""SELECT event_id, (event_id % 9) || '. [node] ' || event_type || chr(10) || '  cause: u' || user_id || chr(10) || '    cause: k' || (event_id % 3) || CASE WHEN event_id % 2 = 0 THEN chr(10) || '  tags: a, b' ELSE '' END AS line FROM events WHERE event_type = 'error'""")
def error_text(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    causes = F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")))
    tags = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", slots.error_text(F.col("event_id") % 9, F.lit("node"), F.col("event_type"), causes, tags).alias("line"))

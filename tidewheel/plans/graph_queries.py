"""Graphs from the foreign keys of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import graph
from tidewheel.plans.registry import query, table


def _edge(df, src, dst):
    return df.select(src.alias("src"), dst.alias("dst"))


def _key(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _trade(spark, sf_dir, urgent: bool = False):
    """Start -> regions -> nations -> customers -> orders -> End; suppliers are nodes without an edge into them."""
    t = lambda n: table(spark, sf_dir, n)
    orders = t("orders").where("o_orderpriority = '1-URGENT'") if urgent else t("orders")
    edges = (
        _edge(t("region"), F.lit("Start"), _key("r", "r_regionkey")).union(_edge(t("nation"), _key("r", "n_regionkey"), _key("n", "n_nationkey")))
        .union(_edge(t("customer"), _key("n", "c_nationkey"), _key("c", "c_custkey"))).union(_edge(orders, _key("c", "o_custkey"), _key("o", "o_orderkey")))
        .union(_edge(orders, _key("o", "o_orderkey"), F.lit("End")))
    )
    nodes = graph.universe(edges).where("node not in ('Start', 'End')").union(t("customer").select(_key("c", "c_custkey"))).union(t("supplier").select(_key("s", "s_suppkey"))).distinct()
    return nodes, edges


@query("""SELECT 's' || s_suppkey AS node FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def graph_reachable(spark, sf_dir):
    """Registered nodes that Start does not reach."""
    return graph.unreachable(*_trade(spark, sf_dir))


@query("""WITH u AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT * FROM u)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c))
SELECT 's' || s_suppkey AS node FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT * FROM u)
UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM n) UNION ALL SELECT 'r' || r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM n)""")
def graph_dead_ends(spark, sf_dir):
    return graph.dead_ends(*_trade(spark, sf_dir, urgent=True))


@query("""WITH e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
l0 AS (SELECT node, row_number() OVER (ORDER BY node) AS rank FROM (SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e))),
l1 AS (SELECT node, row_number() OVER (ORDER BY via, node) + (SELECT count(*) FROM l0) AS rank FROM (SELECT dst AS node, max(rank) AS via FROM e JOIN l0 ON src = node GROUP BY dst)),
l2 AS (SELECT node, row_number() OVER (ORDER BY via, node) + (SELECT count(*) FROM l0) + (SELECT count(*) FROM l1) AS rank FROM (SELECT dst AS node, max(rank) AS via FROM e JOIN l1 ON src = node GROUP BY dst))
SELECT node, 0 AS level, rank::INT AS rank FROM l0 UNION ALL SELECT node, 1, rank::INT FROM l1 UNION ALL SELECT node, 2, rank::INT FROM l2""")
def graph_topo(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return graph.topological(_edge(n, _key("r", "n_regionkey"), _key("n", "n_nationkey")).union(_edge(s, _key("n", "s_nationkey"), _key("s", "s_suppkey"))))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * n_nationkey + 1) % 25 AS b FROM nation),
w AS (SELECT a AS node, b AS here, 1 AS k FROM e UNION SELECT w.node, e.b, k + 1 FROM w JOIN e ON w.here = e.a WHERE k < 25) SELECT DISTINCT node::VARCHAR AS node FROM w WHERE node = here""")
def graph_cycle_nodes(spark, sf_dir):
    n = F.col("n_nationkey")
    return graph.on_cycles(_edge(table(spark, sf_dir, "nation"), n.cast("string"), ((n * n + 1) % 25).cast("string")))


@query("""SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def graph_duplicate_edges(spark, sf_dir):
    return graph.duplicate_edges(_edge(table(spark, sf_dir, "lineitem"), _key("s", "l_suppkey"), _key("p", "l_partkey")))


@query("""WITH e AS (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, (SELECT count(*) FROM e WHERE src = node)::BIGINT AS n_out, (SELECT count(*) FROM e WHERE dst = node)::BIGINT AS n_in FROM n""")
def graph_stats(spark, sf_dir):
    e = _edge(table(spark, sf_dir, "customer"), _key("n", "c_nationkey"), _key("c", "c_custkey")).union(_edge(table(spark, sf_dir, "nation"), _key("r", "n_regionkey"), _key("n", "n_nationkey")))
    return graph.degrees(graph.universe(e), e)


@query("""WITH p AS (SELECT n_regionkey, list(('edge:' || n_regionkey || '->' || n_name) ORDER BY 'edge:' || n_regionkey || '->' || n_name) AS parts FROM nation GROUP BY 1),
b AS (SELECT n_regionkey, len(parts) AS n_parts, list_transform(range(0, len(hex(array_to_string(parts, chr(1)))::VARCHAR) // 2), lambda i: ('0x' || substr(hex(array_to_string(parts, chr(1))), (2 * i + 1)::INT, 2))::INT) AS bytes FROM p),
c AS (SELECT n_regionkey, n_parts, list_concat(list_transform(bytes, lambda x: CASE WHEN x = 1 THEN 255 ELSE x END), [255]) AS bytes FROM b),
h AS (SELECT n_regionkey, n_parts, list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(bytes, lambda x: x::HUGEINT)), lambda h, x: (((h - h % 256) + xor((h % 256)::INT, x::INT)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS hash FROM c)
SELECT n_regionkey, n_parts::INT AS n_parts, lpad(lower(printf('%x', hash::UBIGINT)), 16, '0') AS hash FROM h""")
def graph_hash(spark, sf_dir):
    lines = table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lit("edge:"), F.col("n_regionkey").cast("string"), F.lit("->"), "n_name").alias("line"))
    return graph.graph_hash(lines, ["n_regionkey"])


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * n_nationkey + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey * 2 + 3) % 25 FROM nation),
w AS (SELECT n_nationkey AS seed, n_nationkey AS node FROM nation WHERE n_nationkey % 5 = 0 UNION SELECT seed, b FROM w JOIN e ON node = a) SELECT seed, count(*)::BIGINT AS n_nodes FROM w GROUP BY 1""")
def superstep_bfs(spark, sf_dir):
    """Each session starts at its own node and spreads until nothing is new; sessions share one plan."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    e = _edge(n, k, (k * k + 1) % 25).union(_edge(n, k, (k * 2 + 3) % 25)).distinct()
    seeds = n.where("n_nationkey % 5 = 0").select(k.alias("seed"), k.alias("node"))
    return graph.spread(e, seeds, "seed").groupBy("seed").agg(F.count("*").alias("n_nodes"))

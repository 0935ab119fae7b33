"""Graph operators over nodes(node) and edges(src, dst, pos); encoded or plain names, Start and End virtual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.hashing import fnv_parts
from tidewheel.materialize import cut
from tidewheel.model import END, START, GraphError, encode_node, is_virtual


def node_order(c: Column) -> list[Column]:
    """Start first, End last, names ascending."""
    return [F.when(c == START, 0).when(c == END, 2).otherwise(1), c]


def universe(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


#: Rows up to which the front of a search is sent to every executor instead of being dealt by node.
FRONT = 100_000


def _small(front: DataFrame, n: int) -> DataFrame:
    return F.broadcast(front) if n <= FRONT else front


def spread(edges: DataFrame, seeds: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, node) that each session's seeds(key, node) reach, themselves included: all sessions in one plan a round.

    Edges are written once; a round joins the new front only, and looks up what is known already among its candidates."""
    e = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("next__")).distinct())
    seen = front = cut(seeds.select(key, "node").distinct())
    n, rounds = front.count(), 0
    while n:
        found = e.join(_small(front, n), "node").select(key, F.col("next__").alias("node")).distinct()
        front = cut(found.join(seen, [key, "node"], "left_anti"))
        n, rounds = front.count(), rounds + 1
        if n:
            seen = seen.union(front) if rounds % 16 else cut(seen.union(front))
    return seen


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that seeds(node) reach, themselves included."""
    return spread(edges, seeds.withColumn("one__", F.lit(0)), "one__").select("node")


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def unreachable(nodes: DataFrame, edges: DataFrame, start: str = START) -> DataFrame:
    seed = nodes.sparkSession.createDataFrame([(start,)], "node string")
    return nodes.select("node").distinct().join(reachable(edges, seed), "node", "left_anti")


def dead_ends(nodes: DataFrame, edges: DataFrame, end: str = END) -> DataFrame:
    return unreachable(nodes, flipped(edges), end)


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


def ranked(rows: DataFrame, order: list[Column], base: int = 0, name: str = "rank") -> DataFrame:
    """rows with their place by `order`, from base + 1, without a window over all of them in one task: rows are dealt by
    range, numbered inside each part, and a part's offset is the number of rows in the parts before (a row a part)."""
    keys = [f"k{i}__" for i in range(len(order))]
    dealt = cut(rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).withColumn("part__", F.spark_partition_id()))
    sizes = sorted(dealt.groupBy("part__").agg(F.count("*").alias("n")).collect())
    before, total = [], base
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = dealt.sparkSession.createDataFrame(before, "part__ int, before__ bigint")
    nth = F.row_number().over(Window.partitionBy("part__").orderBy(*keys))
    return dealt.join(F.broadcast(offsets), "part__").withColumn(name, (F.col("before__") + nth).cast("bigint")).drop("part__", "before__", *keys)


def topological(edges: DataFrame) -> DataFrame:
    """(node, level, rank) of the nodes off cycles, in the order of Kahn's queue with ties by node_order.

    A level at a time: nodes whose last predecessor has left come next, by that predecessor's rank, then by order. Each
    round touches only the edges out of the level before it: `waiting` holds how many predecessors a node still has."""
    e = cut(edges.select("src", "dst").distinct())
    need = cut(universe(e).join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need")), "node", "left").na.fill(0, ["need"]))
    here = ranked(need.where("need = 0").select("node", F.lit(0).alias("level")), node_order(F.col("node")))
    here = done = cut(here.select("node", "level", "rank"))
    base, level = here.count(), 0
    n, left = base, need.where("need > 0").withColumn("via", F.lit(0).cast("bigint"))
    while n:
        level += 1
        hit = e.join(_small(here.select(F.col("node").alias("src"), "rank"), n), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k"), F.max("rank").alias("r"))
        left = cut(left.join(hit, "node", "left").select("node", (F.col("need") - F.coalesce("k", F.lit(0))).alias("need"), F.greatest("via", F.coalesce("r", F.lit(0))).alias("via")))
        free = left.where("need = 0").select("node", F.lit(level).alias("level"), "via")
        here = cut(ranked(free, [F.col("via"), *node_order(F.col("node"))], base).select("node", "level", "rank"))
        n = here.count()
        base += n
        if n:
            done, left = done.unionByName(here), left.where("need > 0")
            done = done if level % 16 else cut(done)
    return done


#: Edges up to which a graph is looked at on the driver, where a round costs nothing.
LOCAL_EDGES = 100_000


def _left_by_kahn(edges: list[tuple[str, str]]) -> set[str]:
    """Nodes that cycles hold or follow."""
    after, need = _adjacent(edges), dict.fromkeys((n for e in edges for n in e), 0)
    for _, dst in edges:
        need[dst] += 1
    free = [n for n, k in need.items() if not k]
    while free:
        for dst in after.get(free.pop(), ()):
            need[dst] -= 1
            if not need[dst]:
                free.append(dst)
    return {n for n, k in need.items() if k}


def cycle_residue(edges: DataFrame) -> DataFrame:
    """Edges among nodes that cycles hold or follow: what Kahn's elimination leaves; empty means acyclic."""
    e = cut(edges.select("src", "dst").distinct())
    n = e.count()
    if n <= LOCAL_EDGES:
        rows = [(r.src, r.dst) for r in e.collect()]
        left = _left_by_kahn(rows)
        return e.sparkSession.createDataFrame([x for x in rows if x[0] in left and x[1] in left], e.schema)
    while n:
        e2 = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        m = e2.count()
        if m == n:
            break
        e, n = e2, m
    return e


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that return to themselves, however long the way: what stays when nodes without a way in, or without a way out,
    leave by turns, and then reaches itself."""
    e = cycle_residue(flipped(cycle_residue(edges)))
    e = flipped(e)
    walk = spread(e, e.select(F.col("src").alias("session_id"), F.col("dst").alias("node")))
    return walk.where("session_id = node").select("node").distinct()


def is_cyclic(edges: DataFrame) -> bool:
    return not cycle_residue(edges).isEmpty()


def to_indexed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, index) by node_order from 0, and edges as (src_index, dst_index): the form that graph libraries take."""
    every = universe(edges).union(nodes.select("node")).distinct()
    at = ranked(every, node_order(F.col("node")), -1, "index")
    side = lambda c: at.select(F.col("node").alias(c), F.col("index").alias(f"{c}_index"))
    return at, edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst").select("src_index", "dst_index")


def _adjacent(edges: list[tuple[str, str]]) -> dict[str, list[str]]:
    after: dict[str, list[str]] = {}
    for src, dst in edges:
        after.setdefault(src, []).append(dst)
    return after


def closed_path(edges: list[tuple[str, str]]) -> list[str] | None:
    """A closed path, from the smallest name that leads to one and along the smallest names; its first node ends it."""
    after = {n: sorted(set(d)) for n, d in _adjacent(edges).items()}
    seen: set[str] = set()
    for root in sorted(after):
        path: list[str] = []
        at: dict[str, int] = {}
        todo = [iter([root])]
        while todo:
            node = next(todo[-1], None)
            if node is None:
                todo.pop()
                if path:
                    at.pop(path.pop())
            elif node in at:
                return [*path[at[node] :], node]
            elif node not in seen:
                seen.add(node)
                at[node] = len(path)
                path.append(node)
                todo.append(iter(after.get(node, [])))
    return None


def cycle_witness(edges: DataFrame) -> list[str] | None:
    """closed_path of the residue, which is as large as the definition of a workflow."""
    return closed_path([(r.src, r.dst) for r in cycle_residue(edges).collect()])


def _reached(edges: list[tuple[str, str]], start: str) -> set[str]:
    after, seen, todo = _adjacent(edges), {start}, [start]
    while todo:
        for n in after.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def first_violation(nodes: list[str], edges: list[tuple[str, str]], conditionals: list[str]) -> tuple[str, list[str]] | None:
    """Kind and names of the first violation of a definition held by the driver, in the order of `violations`."""
    if not any(s == START for s in [*(a for a, _ in edges), *conditionals]):
        return "missing entry", [START]
    if path := closed_path(edges):
        return "cycle", path
    if not conditionals:  # a predicate may lead anywhere
        for kind, seen in (("unreachable", _reached(edges, START)), ("no path to End", _reached([(b, a) for a, b in edges], END))):
            if lost := sorted(set(nodes) - seen):
                return kind, lost
    known = {*nodes, START, END}
    for kind, bad in (
        ("duplicate edge", sorted({e for e in edges if edges.count(e) > 1})[:1] if len(set(edges)) < len(edges) else []), ("edge from End", sorted({(b,) for a, b in edges if a == END})),
        ("unknown source", sorted({(a,) for a, _ in edges if a not in known})), ("unknown target", sorted({(b,) for _, b in edges if b not in known})),
    ):
        if bad:
            return kind, [n for e in bad for n in e]
    return None


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    return nodes.select("node").distinct().join(out, "node", "left").join(into, "node", "left").na.fill(0, ["n_out", "n_in"])


def graph_hash(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """FNV-1a of each group's sorted lines, so the order of insertion doesn't count."""
    return lines.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("parts")).select(*keys, F.size("parts").alias("n_parts"), fnv_parts(F.col("parts")).alias("hash"))


def metadata(nodes: DataFrame, edges: DataFrame, conditionals: DataFrame, reducers: DataFrame, keys: list[str]) -> DataFrame:
    """Per graph: hash of its sorted node, edge, conditional and reducer lines, and their counts.

    nodes(keys, node), edges(keys, src, dst), conditionals(keys, src), reducers(keys, label). The order of insertion doesn't
    count, the number of conditionals of a source does."""
    line = lambda df, kind, text: df.select(*keys, F.lit(kind).alias("kind"), text.alias("text"))
    stored = encode_node
    rows = line(nodes.distinct(), 0, F.concat(F.lit("node:"), stored(F.col("node"))))
    rows = rows.unionByName(line(edges, 1, F.concat(F.lit("edge:"), stored(F.col("src")), F.lit("->"), stored(F.col("dst")))))
    rows = rows.unionByName(line(conditionals, 2, stored(F.col("src")))).unionByName(line(reducers, 3, F.concat(F.lit("reducer:"), F.col("label"))))
    n = [F.count_if(F.col("kind") == k).alias(c) for k, c in enumerate(("n_nodes", "n_edges", "n_conditionals", "n_reducers"))]
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "text"))).alias("r"), *n)
    of = lambda k: F.transform(F.filter("r", lambda x: x["kind"] == k), lambda x: x["text"])
    numbered = F.transform(of(2), lambda x, i: F.concat(F.lit("conditional:"), i.cast("string"), F.lit(":"), x))
    parts = F.concat(F.array(F.lit("graph-v1")), of(0), of(1), numbered, of(3))
    return g.select(*keys, "n_nodes", "n_edges", "n_conditionals", "n_reducers", fnv_parts(parts).alias("hash"))


#: Names that an error lists; they are the first in order.
LISTED = 1000


def violations(nodes: DataFrame, edges: DataFrame, conditionals: DataFrame) -> DataFrame:
    """(priority, kind, a, b) of every violation but cycles: missing entry 0, unreachable 2, no path to End 3, duplicate edge 4,
    edge from End 5, unknown source 6, unknown target 7."""
    e = cut(edges.select("src", "dst"))
    names = nodes.select("node").distinct()
    mark = lambda df, k, kind, a, b=None: df.select(F.lit(k).alias("priority"), F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast("string")).alias("b"))
    entry = e.select("src").union(conditionals.select("src")).where(F.col("src") == START).limit(1)
    one = nodes.sparkSession.createDataFrame([(START,)], "src string").join(entry, "src", "left_anti")
    found = mark(one, 0, "missing entry", "src")
    if conditionals.isEmpty():  # a predicate may lead anywhere
        found = found.unionByName(mark(unreachable(names, e), 2, "unreachable", "node")).unionByName(mark(dead_ends(names, e), 3, "no path to End", "node"))
    known = lambda c: e.where(~is_virtual(F.col(c))).select(c).distinct().join(names.withColumnRenamed("node", c), c, "left_anti")
    found = found.unionByName(mark(duplicate_edges(e), 4, "duplicate edge", "src", "dst")).unionByName(mark(e.where(F.col("src") == END), 5, "edge from End", "dst"))
    return found.unionByName(mark(known("src"), 6, "unknown source", "src")).unionByName(mark(known("dst"), 7, "unknown target", "dst"))


def validate(nodes: DataFrame, edges: DataFrame, conditionals: DataFrame) -> None:
    """Raises the first violation: entry, cycle, unreachable, no path to End, duplicate, edge from End, unknown names."""
    if edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES and nodes.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        listed = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
        if found := first_violation([n for (n,) in listed(nodes, "node")], listed(edges, "src", "dst"), [n for (n,) in listed(conditionals.distinct(), "src")]):
            raise GraphError(*found)
        return
    found = cut(violations(nodes, edges, conditionals))
    first = found.agg(F.min("priority").alias("p")).first().p
    if (first is None or first > 0) and (path := cycle_witness(edges)):
        raise GraphError("cycle", path)
    if first is not None:
        rows = found.where(F.col("priority") == first).orderBy("a", "b").limit(1 if first == 4 else LISTED).collect()
        raise GraphError(rows[0].kind, [rows[0].a, rows[0].b] if first == 4 else [r.a for r in rows])


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    """Text for Graphviz of a workflow graph (as large as its definition); indices by node_order."""
    at, pairs = to_indexed(nodes, edges)
    paint = {START: ', style=filled, fillcolor="lightgreen"', END: ', style=filled, fillcolor="lightcoral"'}
    lines = [f'    {r["index"]} [label="{r.node}"{paint.get(r.node, "")}]' for r in at.orderBy("index").collect()]
    lines += [f"    {r.src_index} -> {r.dst_index}" for r in pairs.orderBy("src_index", "dst_index").collect()]
    return "digraph {\n" + "\n".join(lines) + "\n}\n"

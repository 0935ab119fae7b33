"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidewheel.operators import graph
from tidewheel.operators.engine import Deltas, Workflow
from tidewheel.plans import catalog
from tidewheel.streaming import hub

HEADLINE = [
    "msg_append", "extra_last_writer", "extra_version", "error_order", "barrier_step", "version_gate", "superstep_gate", "route_threshold", "frontier_next", "workflow_final",
    "graph_reachable", "graph_topo", "graph_duplicate_edges", "graph_hash", "ckpt_page", "ckpt_latest", "ckpt_retention", "replay_diff", "event_display", "json_path", "hub_lag", "metrics", "iterative_runs",
]


def linear(n: int) -> Workflow:
    return shaped([[f"n{k}"] for k in range(n)])


def shaped(layers: list[list[str]]) -> Workflow:
    """Start, then each layer with edges to all of the next one, then End."""
    w = Workflow({n: lambda sessions, state: Deltas() for layer in layers for n in layer})
    for a, b in zip([["Start"], *layers], [*layers, ["End"]], strict=True):
        w.edges += [(x, y) for x in a for y in b]
    return w


def diamond(depth: int, width: int) -> Workflow:
    return shaped([[f"d{k}x{j}" for j in range(width)] for k in range(depth)])


def publish(events: int) -> None:
    """A new bus, started, fed, drained and stopped."""
    bus = hub.Bus(hub.BusConfig(1024))
    bus.add("memory", hub.MemorySink()).start()
    for k in range(events):
        bus.publish(hub.event("diagnostic", "bench", f"e{k}"))
    bus.stop()


#: Workloads of the driver alone, in the shapes that the baseline lists without figures.
DRIVER = {
    **{f"compile_linear_{n}": lambda n=n: linear(n).compile() for n in (10, 50, 100, 200)}, **{f"compile_fan_out_{n}": lambda n=n: shaped([[f"f{k}" for k in range(n)]]).compile() for n in (10, 50, 100)},
    **{f"compile_diamond_{d}x{w}": lambda d=d, w=w: diamond(d, w).compile() for d, w in ((5, 10), (10, 10), (5, 20))}, **{f"publish_{n}": lambda n=n: publish(n) for n in (64, 256, 1024)},
}


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["event_display"](spark, folder).write.format("noop").mode("overwrite").save()  # the session's own start
    took = {}
    for name, run in DRIVER.items():
        start = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - start, 6)
    edges = spark.createDataFrame(diamond(5, 10).edges, "src string, dst string")
    start = time.time()
    graph.topological(edges).write.format("noop").mode("overwrite").save()
    took["topological_diamond_5x10"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

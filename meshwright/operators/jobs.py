"""Plans of jobs, running them within limits, and methods called by name."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from meshwright.functions import grouping


def plan(graphs: DataFrame, methods: list[str], seeds: list[int], blocked: dict[str, str] | None = None) -> DataFrame:
    """(job_id, graph_id, method, seed, blocked): every graph with every method and seed; ``blocked`` says why a method can't run."""
    kinds = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(s).alias("seed"), F.lit((blocked or {}).get(m)).cast("string").alias("blocked")) for m in methods for s in seeds))
    rows = graphs.select("graph_id").distinct().select("graph_id", F.inline(kinds))
    return rows.select(F.concat_ws("--", "graph_id", "method", F.concat(F.lit("s"), "seed")).alias("job_id"), "graph_id", "method", "seed", "blocked")


def shuffled(jobs: list, seed: int) -> list:
    """A list in the order of Python's generator for a seed."""
    out = list(jobs)
    random.Random(seed).shuffle(out)
    return out


def run_jobs(spark: SparkSession, jobs: dict[str, Callable[[], DataFrame]], wall: float, out: str, done: set[str] | None = None) -> list[tuple[str, str, float]]:
    """(job, status, seconds) of jobs run one after another, each result written once below ``out``.

    A job over ``wall`` seconds is cancelled as a Spark job group and recorded as
    TIMEOUT, a failing one as ERROR; jobs named in ``done`` are not run again.
    """
    rows = []
    for name, job in jobs.items():
        if name in (done or set()):
            continue
        state: dict[str, str] = {}

        def work(name: str = name, job: Callable[[], DataFrame] = job, state: dict[str, str] = state) -> None:
            spark.sparkContext.setJobGroup(name, name, True)
            try:
                job().write.mode("errorifexists").parquet(f"{out}/{name}")
                state["status"] = "COMPLETED"
            except Exception:  # the record is the outcome
                state.setdefault("status", "ERROR")

        began = time.monotonic()
        t = InheritableThread(target=work)
        t.start()
        t.join(wall)
        if t.is_alive():
            state["status"] = "TIMEOUT"
            spark.sparkContext.cancelJobGroup(name)
            t.join(30)
        rows.append((name, state.get("status", "ERROR"), time.monotonic() - began))
    return rows


#: Grouping methods by name, for one graph's rows.
METHODS: dict[str, Callable[[dict, int], dict[int, int]]] = {
    "components": lambda rows, seed: {u: b[0] for b in grouping.connected(rows, set(rows)) for u in b},
    "local_moves": lambda rows, seed: grouping.louvain(rows, seed=seed),
}


@udtf(returnType="graph_id string, cid bigint, node bigint")
class GroupGraph:
    """A table function over (graph_id, u, v, w, method, seed) rows partitioned by graph: the named method's cover."""

    def __init__(self):
        self.rows: dict[int, dict[int, int]] = {}
        self.how = None

    def eval(self, row):
        self.how = row["graph_id"], row["method"], row["seed"]
        self.rows.setdefault(row["u"], {})[row["v"]] = row["w"]
        self.rows.setdefault(row["v"], {})[row["u"]] = row["w"]

    def terminate(self):
        if self.how:
            graph, method, seed = self.how
            for u, c in sorted(METHODS[method](self.rows, seed).items()):
                yield graph, c, u


def grouped(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(graph_id, cid, node) of small graphs (graph_id, u, v, w, method, seed), one task a graph."""
    spark.udtf.register("group_graph", GroupGraph)
    return spark.sql("SELECT * FROM group_graph(TABLE({edges}) PARTITION BY graph_id)", edges=edges)

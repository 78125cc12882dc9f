"""What the operators share: the shared folder, written intermediate tables, free column names, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of keys (at most 64 bytes each) up to which it may be broadcast: 13 MB at most.
BROADCAST_ROWS = 200_000
#: Edges that a task contracts at once, about.
FOREST = 100_000

#: How Python workers allocate: a worker outlives its task, and would keep the most that it ever held.
FREED = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}

_ROWS: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset a temporary one serves a
    local master (tests); on a cluster that would be another disk for each machine, so it is an error there."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="joulemark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there, and executors can be lost. Its rows are counted
    as they are written."""
    path, seen = new_path(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _ROWS[out], _PATHS[out] = seen.get["n"], path
    return out


def rows(df: DataFrame) -> int:
    """Of a written table without a job, else by a count."""
    return _ROWS[df] if df in _ROWS else df.count()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Spark's file systems, wherever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Shuffle files and broadcasts of queries that have been written go when the driver collects its garbage; now. The
    executors collect theirs too: a heap that one step has grown is given back, and not held beside the next step's workers."""
    gc.collect()
    sc = spark.sparkContext
    sc._jvm.System.gc()
    if not sc.master.startswith("local[") and sc.master != "local":
        n = sc.defaultParallelism  # as many tasks as there are cores reach all executors that are free
        spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def free_name(name: str, *taken: Iterable[str]) -> str:
    """name, or name with underscores in front, so that it is no column of taken (as Spark compares names: by lower case)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = "_" + name
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds at once, also where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    # workers find this package also where the session was begun elsewhere, and give back what they have freed
    for name, value in ({"PYTHONPATH": str(Path(__file__).resolve().parents[2])} | FREED).items():
        spark.sparkContext.environment.setdefault(name, value)


def lookup(left: DataFrame, right: DataFrame, on: str, how: str = "left", n: int | None = None) -> DataFrame:
    """Join with a written table of n rows, one for each key. It is broadcast if its count shows that it is small;
    otherwise both sides are dealt by the key, and adaptive execution splits partitions of hot keys."""
    if (rows(right) if n is None else n) <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return left.join(right, on, how)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges a-b: every node, and the smallest node of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while True:  # the ends' labels, and what they label, go to the lower one; paths are shortened
        low = np.minimum(label[x], label[y])
        before = label.copy()
        for end in (x, y):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges as stars around the smallest node: a goes to b, for every node."""
    held, n = [], 0
    for x in batches:
        held.append(x)
        n += len(x)
        if n >= 4 * FOREST:
            a, b = forest(*(np.concatenate([h[c].to_numpy() for h in held]) for c in ("a", "b")))
            yield pd.DataFrame({"a": a, "b": b})
            held, n = [], 0
    if n:
        a, b = forest(*(np.concatenate([h[c].to_numpy() for h in held]) for c in ("a", "b")))
        yield pd.DataFrame({"a": a, "b": b})


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (node, component), component being the smallest node reachable. Nodes without an edge are absent.

    Contraction in random order: in each round every task, of about FOREST edges, turns them into stars; where one task
    has all, that is the answer. Else every node goes into whichever of itself and its neighbours comes first by a hash
    that changes with the round, and edges between what remains go on. That leaves a fraction of the nodes of any graph,
    a long path too. First neighbours are found by map-side aggregation, so that a hub's edges never meet in one task;
    joins' hot partitions are split. Every round is written, which ends its lineage, and removed once used. (60 rounds
    are enough for more nodes than a long can number; not settling is an error, never a shorter result.)
    """
    e = written(edges.where("a <> b").select("a", "b").distinct(), "components-edges")
    steps: list[DataFrame] = []
    for k in range(rounds):
        if not rows(e):
            break
        tasks = -(-rows(e) // FOREST)
        stars = e.coalesce(tasks).mapInPandas(_contracted, "a long, b long")
        if tasks == 1:
            steps.append(written(stars.toDF("node", "into"), "components-step"))
            break
        before, e = e, written(stars.where("a <> b").distinct(), "components-edges")
        discard(before)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda c, k=k: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("x"))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("low"))
        low = written(low.select("node", F.least("low", place("node")).getField("x").alias("into")), "components-step")
        steps.append(low)
        n = rows(low)
        more = lookup(lookup(e, low.toDF("a", "_a"), "a", n=n), low.toDF("b", "_b"), "b", n=n).where("_a <> _b")
        before, e = e, written(more.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct(), "components-edges")
        discard(before)
    else:
        raise RuntimeError("components have not settled")
    if not steps:
        return written(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
    # from the last round back: where a node's target went
    into = steps[-1]
    for low in reversed(steps[:-1]):
        later = into.toDF("into", "_into")
        before, into = into, written(lookup(low, later, "into", n=rows(into)).select("node", F.coalesce("_into", "into").alias("into")), "components-into")
        discard(before, low)
    least = written(into.groupBy("into").agg(F.min("node").alias("component")), "components-least")
    out = written(lookup(into, least, "into").select("node", "component"), "components")
    discard(into, least, e)
    return out


def joined_components(component: DataFrame, links: DataFrame) -> DataFrame:
    """component (node, component), written, as it is with more links (a, b)."""
    a, b = component.toDF("a", "_a"), component.toDF("b", "_b")
    n = rows(component)
    ends = lookup(lookup(links, a, "a", n=n), b, "b", n=n).select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    up = connected_components(ends).toDF("component", "_into")
    fresh = lookup(links.select(F.explode(F.array("a", "b")).alias("node")), component, "node", "left_anti", n=n).distinct()
    every = component.unionByName(fresh.select("node", F.col("node").alias("component")))
    return written(lookup(every, up, "component", n=n).select("node", F.coalesce("_into", "component").alias("component")), "components")

"""What the operators of this package share: the shared folder, hashes of ids, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (tests, local mode) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that its machines share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Tables that cut lineage: written to the shared folder, read back, dropped when no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        """The table once more, as a DataFrame of its own (for joins with itself)."""
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        try:
            self.drop()
        except Exception:  # the session has gone; its folder is the cluster's to clean
            pass


def put_bytes(spark: SparkSession, uri: str, data: bytes) -> None:
    """Writes one file of bounded size by Hadoop's file system, whatever store the shared folder is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def batch_rows(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows of an Arrow batch, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: So many edges (16 MB) are contracted at once in one task; more first shrink in rounds.
ONE_TASK = 1_000_000


def spanning(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Label of each of n nodes: the smallest node that the pairs connect it with."""
    label = np.arange(n)
    for x, y in pairs:
        while True:
            a, b = label[x], label[y]
            differ = a != b
            if not differ.any():
                break
            x, y = x[differ], y[differ]
            np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
            while (label[label] != label).any():
                label = label[label]
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(old, new) of all nodes of a task's edges, which are at most ONE_TASK: new is the least node that is reachable."""
    own = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if own:
        a, b = (np.concatenate([x[k] for x in own]) for k in range(2))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = spanning(len(nodes), [(place[: len(a)], place[len(a) :])])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["old", "new"])


def components(ws: Workspace, edges: DataFrame, name: str, max_rounds: int = 60, one_task: int | None = None) -> DataFrame:
    """Connected components of edges (a, b) of longs: one row (node, component), component the smallest node.

    Each round every node points at its neighbour (or itself) of least hash, edges are contracted to
    those leaders, and the pointers are kept; hashes change by the round, so that paths, stars and
    cliques all shrink by a constant factor. Once at most ONE_TASK edges are left, which are counted, one task
    contracts the rest. Rows of a hub meet in partially aggregated minima; joins are plain equi-joins that AQE
    may split. Every round is written to the shared folder. Loops and repeated edges do no harm; null ends are ignored.
    """
    one_task = ONE_TASK if one_task is None else one_task
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, pointer = ws.save(edges, f"{name}-e0"), None
    for k in range(max_rounds):
        n = edges.count()
        if not n:
            break
        if n <= one_task:
            step = ws.save(edges.coalesce(1).mapInArrow(_contract, "old long, new long"), f"{name}-s{k}")
        else:
            rank = lambda c: F.xxhash64(F.col(c), F.lit(k))
            ends = edges.select("a", "b").union(edges.select("b", "a"))
            best = ends.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("n"))).alias("m"))
            step = best.select(F.col("a").alias("old"), F.when(F.col("m.r") < rank("a"), F.col("m.n")).otherwise(F.col("a")).alias("new"))
            step = ws.save(step, f"{name}-s{k}")
        if pointer is None:
            pointer2 = step.select(F.col("old").alias("node"), F.col("new").alias("leader"))
        else:
            pointer2 = pointer.join(step, pointer.leader == step.old, "left").select("node", F.coalesce("new", "leader").alias("leader"))
        if n <= one_task:
            if not k:
                return pointer2.withColumnRenamed("leader", "component")
            pointer = ws.save(pointer2, f"{name}-p{k + 1}")
            break
        pointer2 = ws.save(pointer2, f"{name}-p{k + 1}")
        e = edges.join(step.select(F.col("old").alias("a"), F.col("new").alias("a2")), "a")
        e = e.join(step.select(F.col("old").alias("b"), F.col("new").alias("b2")), "b")
        e = e.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges2 = ws.save(e, f"{name}-e{k + 1}")
        for old in (f"{name}-p{k}", f"{name}-e{k}"):
            ws.drop(old)
        if k:
            ws.drop(f"{name}-s{k}")
        pointer, edges = pointer2, edges2
    else:
        raise RuntimeError(f"components: {max_rounds} rounds did not contract the graph")
    if pointer is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))  # no edge, no node
    least = pointer.groupBy("leader").agg(F.min("node").alias("component"))
    return join_few(pointer, least, "leader").select("node", "component")


def join_few(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins facts (one row a key). They are broadcast if counted to be few, so that rows of a hot key stay where they are; else both sides are shuffled, and AQE may split hot keys."""
    return rows.join(F.broadcast(facts) if facts.count() <= BROADCAST_IDS else facts, key, how)


#: So many ids are broadcast (8 MB); more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id isn't among the ids. Texts stay in place if the ids, which are counted, are few; else both sides are shuffled."""
    ws = Workspace(docs.sparkSession)
    ids = ws.save(ids.select(F.col("doc_id").alias("_dropped")).where("_dropped is not null").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["_dropped"], "left_anti")

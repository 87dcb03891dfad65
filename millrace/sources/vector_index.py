"""Vector indexes: for each data file of a table one segment of inverted lists, merged when searched.

A segment's vectors are dealt to about the square root of their number of lists by k-means (trained on at most TRAIN of them). A
list is a row of Parquet: file, list, centroid, radius (the farthest of its vectors), positions of its rows in the file, and their
vectors. A header (JSON, created once and whole) names an index build's metric, dimension, folder and segments. A search ranks each
segment's lists by their centroids, reads the nearest PROBES share of them, keeps the k best of each task and merges them. Then it reads
every other list that by the triangle inequality may hold a vector nearer than the k-th of these, so that what it finds are the k nearest; vectors
that form no groups leave few lists out. Each of many queries has its own lists, but ASKED of them go through the segments together. Data files without a segment are scanned, so a table is searched as a whole whether or not
its last writes are indexed. Rows are read back by position.

Null vectors are in no list. Lists without a radius (version 1) or with components that aren't finite are always read. Which of several rows at the
distance of the k-th are found is open. Distances of what is found are computed from the rows themselves.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import DataFile, located
from millrace.errors import InvalidSchema
from millrace.functions import vectors
from millrace.sources.files import Files

MAGIC, VERSION = "millrace-lists", 2
#: Vectors that a segment's centroids are trained on, rounds of k-means, most lists of a segment, and the share of lists that a search reads first.
TRAIN, ROUNDS, MOST_LISTS, PROBES = 16_384, 6, 4096, 0.4
_ROWS = "file string, list int, centroid array<float>, positions binary, data binary, radius double"
#: Queries that go through the lists together.
ASKED = 1024
#: Share by which bounds are widened, far above the rounding of doubles.
SLACK = 1e-9


@dataclass
class Build:
    column: str
    metric: str
    dim: int
    path: str
    files: list[str]


def _normed(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vectors.EPSILON) if metric == "cosine" else x


def _exact(x: np.ndarray, metric: str) -> np.ndarray:
    """In double precision, for the cosine of length 1 (or 0)."""
    x = x.astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n) if metric == "cosine" else x


def _bounds(q: np.ndarray, c: np.ndarray, radius: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """For each query distances of centroids, and those that no vector within their radius is below (NaN: unknown)."""
    if metric == "l2":
        far = vectors.distances(q, c, metric)
        return far, np.maximum(far - radius - SLACK * (far + radius), 0.0)
    q = _exact(q, metric)
    n, dots = np.linalg.norm(q, axis=1)[:, None], -vectors.distances(q, c, "dot")
    low = -dots - n * radius - SLACK * n * (np.linalg.norm(c.astype(np.float64), axis=1) + radius)
    return -dots, 1 + np.minimum(low, 0.0) if metric == "cosine" else low  # the least denominator of the cosine draws small vectors to 0


def _assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centroids**2).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (half - x[i : i + 4096] @ centroids.T).argmin(axis=1)
    return out


def build(spark: SparkSession, files: Files, table_dir: str, name: str, data: list[DataFile], column: str, metric: str, dim: int) -> Build | None:
    """Indexes data files, each in a task of its own, and creates the header; an index named already is left as it is."""
    if metric not in vectors.METRICS:
        raise InvalidSchema(f"unknown metric {metric}")
    if not data:
        return None

    def segment(t: pa.Table) -> pa.Table:
        at = t.column("at").to_numpy()
        x = np.array(t.column("v").to_pylist(), np.float32).reshape(len(at), -1)
        raw, x = x, _normed(x, metric)
        rng, m = np.random.default_rng(5), max(1, min(MOST_LISTS, round(math.sqrt(len(x)))))
        some = x[rng.permutation(len(x))[:TRAIN]]
        centroids = some[:m].copy()
        for _ in range(ROUNDS):
            near = _assign(some, centroids)
            n = np.bincount(near, minlength=m)
            sums = np.stack([np.bincount(near, some[:, d], m) for d in range(x.shape[1])], 1)
            centroids[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
        near = _assign(x, centroids)
        own = [np.flatnonzero(near == k) for k in range(m)]
        far = lambda k, i: float(np.linalg.norm(_exact(raw[i], metric) - centroids[k].astype(np.float64), axis=1).max())
        rows = [(t.column("file")[0].as_py(), k, centroids[k].tolist(), at[i].astype("<i8").tobytes(), raw[i].tobytes(), far(k, i)) for k, i in enumerate(own) if len(i)]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.list_(pa.float32()), pa.binary(), pa.binary(), pa.float64()))], names=[c.split()[0] for c in _ROWS.split(", ")])

    paths = [f.path for f in data]
    path = f"{table_dir}/index/{name}"
    rows = spark.read.schema(f"`{column}` array<float>").parquet(*paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.col(f"`{column}`").alias("v"))
    rows = rows.where(f"size(v) = {dim} and not exists(v, x -> x is null)")
    rows.groupBy("file").applyInArrow(segment, _ROWS).write.option("compression", "zstd").parquet(path)
    out = Build(column, metric, dim, path, paths)
    files.create(f"{table_dir}/index/{name}.json", json.dumps({"magic": MAGIC, "version": VERSION, **out.__dict__}))
    return out


def builds(files: Files, table_dir: str, column: str | None = None) -> list[Build]:
    """All builds of a table's indexes (of a column); headers of another kind or a later version are an error."""
    out = []
    for path, _, folder in files.list(f"{table_dir}/index"):
        if not folder and path.endswith(".json"):
            d = json.loads(files.read(path))
            if d.pop("magic", None) != MAGIC or d.pop("version", 0) > VERSION:
                raise InvalidSchema(f"{path} isn't an index header that can be read")
            d.pop("version", None)
            if column in (None, d["column"]):
                out.append(Build(**d))
    return out


def hits(spark: SparkSession, found: list[Build], data: list[DataFile], queries: list[list[float]], k: int, metric: str, probes: float | None = None) -> tuple[list[tuple[int, str, int]] | None, list[DataFile]]:
    """(query's place, file, at) of the k nearest rows of the segments for each query, and the data files that no segment covers. ``probes`` is the share of lists read first."""
    found = [b for b in found if b.metric == metric]
    paths = {located(f.path)[1]: f for f in data}
    covered = {located(p)[1] for b in found for p in b.files} & set(paths)
    if not covered:
        return None, data
    index = spark.read.schema(_ROWS).parquet(*(b.path for b in found))
    if len(covered) < sum(len(b.files) for b in found):  # segments of files that the snapshot no longer has
        live = spark.createDataFrame([(p,) for p in sorted(covered)], "live string")
        index = index.join(F.broadcast(live), F.regexp_replace("file", "^[A-Za-z0-9+.-]+:(//[^/]*)?/*", "/") == F.col("live"), "left_semi")
    out: list[tuple[int, str, int]] = []
    for i in range(0, len(queries) if k else 0, ASKED):
        q = np.array(queries[i : i + ASKED], np.float64)
        out += [(i + own, file, at) for own, best in enumerate(_block(index, q, k, metric, PROBES if probes is None else probes)) for _, file, at in best]
    return out, [f for p, f in paths.items() if p not in covered]


def _block(index: DataFrame, q: np.ndarray, k: int, metric: str, share: float) -> list[list[tuple[float, str, int]]]:
    """The k nearest (distance, file, at) of each query of a block, by at most two passes over the lists for all of them together."""

    def asked(far: np.ndarray | None):
        """Of a file's lists those that queries read, with the queries: the nearest share, or with the distances of their k-th rows those of the others that may hold a nearer one."""

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("list")
            d, low = _bounds(q, np.array(t.column("centroid").to_pylist(), np.float32), np.array(t.column("radius").to_pylist(), np.float64), metric)
            read = np.zeros(d.shape, bool)
            np.put_along_axis(read, np.argsort(d, axis=1, kind="stable")[:, : max(1, math.ceil(d.shape[1] * share))], True, 1)
            if far is not None:
                read = ~read & ~(low >= far[:, None])  # NaN: unknown
            kept = np.flatnonzero(read.any(axis=0))
            own = pa.array([np.flatnonzero(read[:, j]) for j in kept], pa.list_(pa.int32()))
            return t.select(["file", "list"]).take(pa.array(kept)).append_column("asked", own)

        return index.select("file", "list", "centroid", "radius").groupBy("file").applyInArrow(run, "file string, list int, asked array<int>")  # at most MOST_LISTS a file

    def best_of(chosen: DataFrame, far: np.ndarray) -> list[list[tuple[float, str, int]]]:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple[float, str, int]]] = {}
            most = far.copy()
            for b in batches:
                for file, at, data, own in zip(b.column("file").to_pylist(), b.column("positions").to_pylist(), b.column("data").to_pylist(), b.column("asked").to_pylist(), strict=True):
                    own, at, x = np.array(own), np.frombuffer(at, "<i8"), np.frombuffer(data, np.float32).reshape(-1, q.shape[1])
                    for i in range(0, len(own), 128):
                        some = own[i : i + 128]
                        d = vectors.distances(q[some], x, metric)
                        for j in np.flatnonzero(~(d.min(axis=1) > most[some])):
                            near = np.argsort(d[j], kind="stable")[:k]
                            new = best.get(n := int(some[j]), []) + [(float(d[j, p]), file, int(at[p])) for p in near]
                            best[n] = new = sorted(new, key=_order)[:k]
                            if len(new) == k:
                                most[n] = np.fmin(far[n], new[-1][0])
            flat = [(n, *r) for n, own in best.items() for r in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.string(), pa.int64()))], ["_query", "_distance", "file", "at"])

        got = index.join(chosen, ["file", "list"]).select("file", "positions", "data", "asked").mapInArrow(rows, "_query int, _distance double, file string, at long")
        out: list[list[tuple[float, str, int]]] = [[] for _ in q]
        for r in vectors.nearest_each(got, k, "file", "at").collect():  # k rows a query at most
            out[r[0]].append(tuple(r[1:]))
        return [sorted(x, key=_order) for x in out]

    best = best_of(asked(None), np.full(len(q), np.inf))
    if share < 1:
        far = np.array([x[-1][0] if len(x) == k else np.nan for x in best])
        more = best_of(asked(far), np.where(np.isnan(far), np.inf, far))
        best = [sorted(a + b, key=_order)[:k] for a, b in zip(best, more, strict=True)]
    return best


def _order(hit: tuple[float, str, int]) -> tuple:
    """As Spark sorts: NaN after all numbers."""
    return (hit[0] != hit[0], 0.0 if hit[0] != hit[0] else hit[0], *hit[1:])


def read_back(spark: SparkSession, schema, data: list[DataFile], at: list[tuple[int, str, int]]) -> DataFrame:
    """Rows of data files by their positions (query's place, file, at), with _query; only files that have one are read."""
    paths = {located(p)[1] for _, p, _ in at}
    files = [f.path for f in data if located(f.path)[1] in paths]
    if not files:
        return spark.createDataFrame([], schema).withColumn("_query", F.lit(0).cast("long"))
    places = spark.createDataFrame(at, "_query long, _file string, _at long")  # as many as were asked for
    rows = spark.read.schema(schema).parquet(*files).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.where(F.col("_row").isin(sorted({i for *_, i in at}))) if len(at) <= 1000 else rows
    return rows.join(F.broadcast(places), (F.col("_path") == F.col("_file")) & (F.col("_row") == F.col("_at"))).drop("_path", "_row", "_file", "_at")

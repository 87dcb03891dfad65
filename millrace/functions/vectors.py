"""Vector distances in column form, top-k search and small nearest-neighbour joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from millrace.plans.registry import Tables, query

C = F.col
#: The least denominator of the cosine, the spacing of 32-bit floats at 1; a zero vector so has distance 1.
EPSILON = 1.1920929e-07


def _sum(a: Column, b: Column, f) -> Column:
    """Sum over component pairs; vectors of different lengths are an error, null vectors or components give null."""
    pairs = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in dimension"))).otherwise(total)


def _fixed(a: Column, b: list[float], f) -> Column:
    """The same for a literal vector: an unrolled sum, which stays inside generated code."""
    total = F.lit(0.0)
    for i, y in enumerate(b):
        total = total + f(F.get(a, F.lit(i)).cast("double"), F.lit(float(y)))
    return F.when(F.size(a) != len(b), F.raise_error(F.lit("vectors differ in dimension"))).otherwise(total)


def _over(a: Column, b: Column | list[float], f) -> Column:
    return _fixed(a, b, f) if isinstance(b, list) else _sum(a, b, f)


def l2_distance(a: Column, b: Column | list[float]) -> Column:
    return F.sqrt(_over(a, b, lambda x, y: (x - y) * (x - y)))


def dot_product(a: Column, b: Column | list[float]) -> Column:
    return _over(a, b, lambda x, y: x * y)


def cosine_distance(a: Column, b: Column | list[float]) -> Column:
    own = F.lit(math.sqrt(sum(float(y) * float(y) for y in b))) if isinstance(b, list) else F.sqrt(_sum(b, b, lambda x, y: x * y))
    norms = F.sqrt(_sum(a, a, lambda x, y: x * y) if not isinstance(b, list) else _fixed(a, b, lambda x, y: x * x)) * own
    return 1 - dot_product(a, b) / F.greatest(norms, F.lit(EPSILON))


METRICS = {"l2": l2_distance, "cosine": cosine_distance, "dot": lambda a, b: -dot_product(a, b)}


def search(df: DataFrame, column: str, vector: list[float], k: int, metric: str = "l2", tie: str | None = None) -> DataFrame:
    """The k rows nearest to a vector with their _distance, ascending: one scan, a heap of k rows a task, one merge."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    found = df.withColumn("_distance", METRICS[metric](C(column), list(vector))).where("_distance is not null")
    return found.orderBy("_distance", *([tie] if tie else [])).limit(k)


#: Query vectors of a block, which is sent to every scan task.
QUERY_ROWS = 4096


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """From each of q to each of x, summed component by component in double precision, so that they are the doubles of the column forms (of two columns)."""
    q, x = np.ascontiguousarray(q.T, np.float64), np.ascontiguousarray(x.T, np.float64)  # a row for each component
    out = np.zeros((q.shape[1], x.shape[1]))
    for i in range(0, out.shape[0], 32):  # blocks that stay in a core's cache
        for j in range(0, out.shape[1], 1024):
            total = out[i : i + 32, j : j + 1024]
            one = np.empty_like(total)
            for a, b in zip(q[:, i : i + 32, None], x[:, None, j : j + 1024], strict=True):
                if metric == "l2":
                    np.subtract(a, b, out=one)
                    one *= one
                else:
                    np.multiply(a, b, out=one)
                total += one
    if metric == "l2":
        return np.sqrt(out, out=out)
    if metric == "dot":
        return np.negative(out, out=out)
    norms = [np.sqrt(sum((v * v for v in y), np.zeros(y.shape[1]))) for y in (q, x)]
    return 1 - out / np.maximum(norms[0][:, None] * norms[1], EPSILON)


def nearest_each(found: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k rows of each _query with the least _distance."""
    rank = F.row_number().over(Window.partitionBy("_query").orderBy("_distance", *ties))
    return found.withColumn("_rank", rank).where(C("_rank") <= k).drop("_rank")


def search_many(df: DataFrame, column: str, queries: list[list[float]], k: int, metric: str = "l2", tie: str | None = None) -> DataFrame:
    """``search`` for many vectors at once: rows with _query, the vector's place in the list, and _distance. One scan for each QUERY_ROWS vectors, k rows of each vector a task, one merge; ties by a column of numbers."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    rows, found = df.where(C(column).isNotNull() & ~F.exists(column, lambda x: x.isNull())), None
    for at in range(0, max(1, len(queries)), QUERY_ROWS):
        block = _scan_block(rows, column, np.array(queries[at : at + QUERY_ROWS], np.float64), at, k, metric, tie)
        found = block if found is None else found.union(block)
    return nearest_each(found, k, *([tie] if tie else []))


def _scan_block(df: DataFrame, column: str, q: np.ndarray, start: int, k: int, metric: str, tie: str | None) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, held = sent.value, None
        far = np.full(len(q), np.inf)  # of each vector's k-th row so far
        for b in batches:
            v = b.column(column)
            if not b.num_rows or not len(q) or not k:
                continue
            if (np.diff(v.offsets.to_numpy()) != q.shape[1]).any():
                raise ValueError("vectors differ in dimension")
            x, new = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), []
            for i in range(0, len(q), 128):
                d = distances(q[i : i + 128], x, metric)
                most = np.fmin(np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.inf, far[i : i + 128])
                own, row = np.nonzero(~(d > most[:, None]))  # with NaN, which is above all numbers
                order = np.lexsort((b.column(tie).to_numpy(zero_copy_only=False)[row] if tie else row, d[own, row], own))
                order = order[_places(own[order]) < k]
                new.append((own[order] + i, row[order], d[own[order], row[order]]))
            own, row, d = (np.concatenate(y) for y in zip(*new, strict=True))
            fresh = pa.Table.from_batches([b]).take(pa.array(row)).append_column("_query", pa.array(own)).append_column("_distance", pa.array(d))
            held = fresh if held is None else pa.concat_tables([held, fresh])
            own, d = held.column("_query").to_numpy(), held.column("_distance").to_numpy()
            order = np.lexsort((held.column(tie).to_numpy() if tie else np.arange(len(d)), d, own))
            place = _places(own[order])
            held = held.take(pa.array(order[place < k]))
            last = order[place == k - 1]
            far[own[last]] = d[last]
        if held is not None:
            at = pa.array(held.column("_query").to_numpy() + start)
            yield from held.set_column(held.schema.get_field_index("_query"), "_query", at).to_batches()

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("_query", LongType()), StructField("_distance", DoubleType())]))


def _places(sorted_: np.ndarray) -> np.ndarray:
    """The place of each item among its equals."""
    return np.arange(len(sorted_)) - np.searchsorted(sorted_, sorted_)


#: The distances as SQL text of two operands. The engine writes them out, as Spark has its own SQL functions not in every clause.
_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v)"
_SAME = "if(size({a}) <> size({b}), raise_error('vectors differ in dimension'), {body})"
FUNCTIONS = {
    "l2_distance": "sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, v) -> s + v))",
    "dot_product": _DOT,
    "cosine_distance": f"1 - {_DOT} / greatest(sqrt({_DOT.replace('{b}', '{a}')}) * sqrt({_DOT.replace('{a}', '{b}')}), {EPSILON}D)",
}


def written_out(name: str, a: str, b: str) -> str:
    """A call of one of the functions as an expression; vectors of different dimension are an error."""
    body = FUNCTIONS[name].format(a=a, b=b)
    return f"({_SAME.format(a=a, b=b, body=body)})"


def _query(d: int = 64) -> list[float]:
    return [((i * 37) % 11 - 5) / 5 for i in range(d)]


_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in _query()) + "]"


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q}), 3) AS d FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10")
def l2_topk(t: Tables) -> DataFrame:
    return search(t.embeddings, "embedding", _query(), 10, "l2", "vec_id").select("vec_id", F.round("_distance", 3).alias("d"))


@query(f"SELECT vec_id, round(-list_inner_product(embedding::DOUBLE[], {_Q}), 3) AS d FROM embeddings ORDER BY -list_inner_product(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10")
def dot_topk(t: Tables) -> DataFrame:
    return search(t.embeddings, "embedding", _query(), 10, "dot", "vec_id").select("vec_id", F.round("_distance", 3).alias("d"))


@query(f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {_Q}), 3) AS d FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {_Q}), vec_id LIMIT 10")
def cosine_topk(t: Tables) -> DataFrame:
    return search(t.embeddings, "embedding", _query(), 10, "cosine", "vec_id").select("vec_id", F.round("_distance", 3).alias("d"))


def nearest(df: DataFrame, key: str, column: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, rn): for each row of ``queries`` (query_id, q) the k nearest rows by L2 in double precision, itself excepted; ties by key.

    Queries go in blocks of at most QUERY_ROWS, one scan each; a scan task passes on its k nearest of each query, so what is
    ranked in the end is k rows a query and task. Vectors of other lengths and null ones are no neighbours.
    """
    rows = queries.where("query_id is not null and q is not null").select("query_id", F.size("q").alias("n"), C("q").cast("array<double>").alias("q"))
    blocks = max(1, -(-rows.count() // QUERY_ROWS))
    out = None
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()  # about QUERY_ROWS rows
        for n in sorted({r.n for r in own}):
            found = _near_block(df, key, column, [r for r in own if r.n == n], n, k)
            out = found if out is None else out.union(found)
    if out is None:
        return df.sparkSession.createDataFrame([], f"query_id long, {key} long, rn long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id")).cast("long")
    return out.withColumn("rn", rank).where(C("rn") <= k).select("query_id", C("id").alias(key), "rn")


def _near_block(df: DataFrame, key: str, column: str, own: list, n: int, k: int) -> DataFrame:
    ids, q = np.array([r.query_id for r in own], np.int64), np.array([r.q for r in own], np.float64).reshape(len(own), n)
    sent = df.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        best_d, best_id = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for b in batches:
            here = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i is not None and v is not None and None not in v]
            if not here:
                continue
            other, x = np.array([i for i, _ in here], np.int64), np.array([v for _, v in here], np.float64)
            for a in range(0, len(ids), 64):
                d = np.sqrt(((q[a : a + 64, None, :] - x[None, :, :]) ** 2).sum(axis=2))
                d[ids[a : a + 64, None] == other[None, :]] = np.inf
                d = np.concatenate([best_d[a : a + 64], d], axis=1)
                i = np.concatenate([best_id[a : a + 64], np.broadcast_to(other, (len(d), len(other)))], axis=1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d[a : a + 64], best_id[a : a + 64] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        row, place = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best_id[row, place]), pa.array(best_d[row, place])], ["query_id", "id", "d"])

    rows = df.where(F.size(column) == n).select(C(key).cast("long").alias("id"), C(column).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "query_id long, id long, d double")


@query("SELECT a AS query_id, b AS vec_id, rn FROM (SELECT q.vec_id AS a, e.vec_id AS b, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS rn FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) WHERE rn <= 3")
def knn_join(t: Tables) -> DataFrame:
    """The three nearest of all other vectors for each stated query vector, those whose id is divisible by 100."""
    return nearest(t.embeddings, "vec_id", "embedding", t.embeddings.where("vec_id % 100 = 0").select(C("vec_id").alias("query_id"), C("embedding").alias("q")), 3)

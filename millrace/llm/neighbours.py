"""Embedding near-duplicates by NN-descent.

Equal vectors are one node. A neighbour graph starts from windows along several random-hyperplane orders and
is refined by joining neighbours of neighbours: members of a node's neighbourhood (both directions) are
compared with each other, and each keeps its K best. Links of the lists, decided in double precision, make components.

A list full of links is saturated and may hide others. So from the second turn on lists are enlarged by K places for
neighbours outside of the node's own component: the descent goes on over all nodes, along new orders (which now also pass
by neighbours of the own component) and by neighbours of neighbours through the lists inside of components, until no
component hides another one's members. Then every component's links are counted exactly, block by block,
without writing pairs, so a link is found if its ends share a component.

After each turn an audit compares newly sampled nodes with all others in blocks, before their links are merged; turns go on
while its recall, over links or averaged over nodes, is below RECALL. After MOST_ROUNDS of them blocks of all nodes are compared
for links between components, which costs their square but loses nothing. The recall of each turn is logged.

Defined cases: null or zero vectors and vectors with a null or non-finite component link with nothing;
so do vectors of different length with each other; a null vec_id is a row that has its vector's class;
ties and repeated rows are links like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import Workspace, batch_rows, components, join_few, spanning

LEAST = 0.9
#: Neighbours kept, orders to start from, window in an order, passes, and the audit's sample and aim.
K, ORDERS, WINDOW, PASSES = 10, 6, 4, 3
AUDIT, RECALL, MOST_ROUNDS = 1024, 0.998, 4
#: The descent's similarities are of rounded components: so much below the threshold is looked at exactly.
SLACK = 0.03
#: Nodes of a block when a component's links are counted, and when all nodes are compared.
BLOCK, REST = 512, 8192

_log = logging.getLogger(__name__)


def prepare(vectors: DataFrame) -> DataFrame:
    """vec_id, key (of the class of equal vectors; null: links with nothing), unit (doubles), code (signed bytes)."""
    batch_rows(vectors.sparkSession, 5000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, units, codes = [], [], []
            for v in b.column(1).to_pylist():
                x = None if v is None or None in v else np.array(v, np.float64)
                top = np.abs(x).max() if x is not None and len(x) else 0.0
                if not (np.isfinite(top) and top > 0):
                    keys.append(None), units.append(None), codes.append(None)
                    continue
                x = x + 0.0  # no negative zeros
                u = x / top
                u = u / math.sqrt(u @ u)
                keys.append(hashlib.sha256(x.tobytes()).digest()[:16])
                units.append(u.tobytes())
                codes.append(np.rint(u / np.abs(u).max() * 127).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.binary()) for c in (keys, units, codes))], ["vec_id", "key", "unit", "code"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, key binary, unit binary, code binary")


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), kind) for x in column]) if len(column) else np.zeros((0, 1), kind)


def _unit32(column: pa.Array) -> np.ndarray:
    m = _matrix(column, np.int8).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


_EDGES = "a long, b long, sim double"


def _edges(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim.astype(np.float64))], ["a", "b", "sim"])


def start(nodes: DataFrame, dim: int, n: int, seed: int, orders: int = ORDERS, window: int = WINDOW) -> DataFrame:
    """Edges between nodes of different components that are near each other in orders by random hyperplanes; range partitioning keeps the orders balanced.

    Besides the window each node meets the nearest node of another component on both sides, however many of its own lie between.
    """
    bits = max(1, min(24, math.ceil(math.log2(max(2, n / 8)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((orders, bits + 1, dim)).astype(np.float32)
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit32(b.column("code"))
            for r in range(orders):
                x = u @ planes[r].T
                where = (x[:, :bits] > 0) @ (1 << np.arange(bits)[::-1])
                where = where ^ (where >> 1) ^ (where >> 2) ^ (where >> 4) ^ (where >> 8) ^ (where >> 16)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), r), pa.int32()), pa.array(where.astype(np.int64)), pa.array(x[:, bits].astype(np.float64)), b.column("node"), b.column("component"), b.column("code")], ["r", "at", "along", "node", "component", "code"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for b in batches:
            whole = pa.Table.from_batches([b])
            whole = pa.concat_tables([last, whole]).combine_chunks() if last is not None else whole
            n = whole.num_rows
            if n > 1:
                u, node, group, r = _unit32(whole.column("code").combine_chunks()), *(whole.column(c).to_numpy() for c in ("node", "component", "r"))
                ends = [np.arange(j, n) for j in range(1, min(window, n - 1) + 1)]
                pairs = [(y - j, y) for j, y in enumerate(ends, 1)]
                cut = np.flatnonzero(group[1:] != group[:-1]) + 1  # where runs of one component end
                run = np.searchsorted(cut, np.arange(n), "right")
                later, earlier = np.flatnonzero(run > 0), np.flatnonzero(run < len(cut))
                pairs += [(cut[run[later] - 1] - 1, later), (earlier, cut[run[earlier]])] if len(cut) < n - 1 else []
                for i, j in pairs:
                    keep = (r[i] == r[j]) & (group[i] != group[j])
                    i, j = i[keep], j[keep]
                    sim = np.einsum("ij,ij->i", u[i], u[j])
                    yield _edges(np.concatenate([node[i], node[j]]), np.concatenate([node[j], node[i]]), np.concatenate([sim, sim]))
            last = whole.slice(max(0, n - window))

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("node", "component", "code").mapInArrow(place, "r int, at long, along double, node long, component long, code binary")
    return rows.repartitionByRange(parts, "r", "at", "along", "node").sortWithinPartitions("r", "at", "along", "node").mapInArrow(link, _EDGES)


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k best different neighbours of each node, one shuffle by node: a node meets no more edges than its neighbourhoods hold."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = edges.repartition(parts, "a").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def refine(lists: DataFrame, inner: DataFrame | None, nodes: DataFrame, k: int, near: float = LEAST - SLACK) -> DataFrame:
    """Edges between components that comparing the members of each neighbourhood finds, if they beat a member's last neighbour: the four best, and all above ``near``.

    A neighbourhood is a node, its neighbours (in ``lists``, and in its own component's lists ``inner``) and at most k of those that
    have it as neighbour, the best ones: neighbours beyond come in by the lists of others and by later passes.
    """
    back = best(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"), k)
    around = lists.select("a", "b").union(back.select("a", "b")).union(nodes.select("node", F.col("node").alias("b")))
    if inner is not None:  # only around nodes that have a neighbour in another component, or are one
        around = around.union(inner.select("a", "b").join(lists.select("a").union(back.select("a")).distinct(), "a", "left_semi"))
    least = lists.groupBy("a").agg(F.min("sim").alias("least"), F.count("*").alias("n")).select("a", F.when(F.col("n") < k, -1.0).otherwise(F.col("least")).alias("least"))
    facts = nodes.join(least, nodes.node == least.a, "left").select("node", "component", "code", F.coalesce("least", F.lit(-1.0)).alias("least"))
    rows = around.join(facts, around.b == facts.node).select("a", "node", "component", "code", "least")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def run(t: pa.Table) -> pa.RecordBatch:
            centre, node, group, least = (t.column(c).to_numpy() for c in ("a", "node", "component", "least"))
            u = _unit32(t.column("code").combine_chunks())
            cut = np.flatnonzero(np.diff(centre)) + 1
            out: list[tuple] = [(node[:0], node[:0], least[:0])]
            for i, j in zip([0, *cut], [*cut, len(centre)], strict=True):
                s = u[i:j] @ u[i:j].T
                s[group[i:j, None] == group[None, i:j]] = -2
                best4 = np.partition(s, -min(4, j - i), axis=1)[:, -min(4, j - i)][:, None] - 1e-6
                x, y = np.nonzero((s > -2) & (s > np.maximum(least[i:j, None], np.minimum(best4, near))))
                out.append((node[i + x], node[i + y], s[x, y]))
            return _edges(*(np.concatenate([o[c] for o in out]) for c in range(3)))

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            centre = t.column("a").to_numpy()
            whole = int(np.searchsorted(centre, centre[-1]))  # the last neighbourhood may go on in the next batch
            if whole:
                yield run(t.slice(0, whole).combine_chunks())
            held = t.slice(whole)
        if held is not None and held.num_rows:
            yield run(held.combine_chunks())

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(compare, _EDGES)


def descend(nodes: DataFrame, before: DataFrame | None, ws: Workspace, name: str, dim: int, seed: int, k: int = K, passes: int = PASSES, near: float = LEAST - SLACK) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, sim): lists of neighbours in other components after the passes, and those of the own component; ``nodes`` holds node, component, code, ``before`` the lists so far. Orders grow with n."""
    n = nodes.count()
    orders = math.ceil(ORDERS * max(1.0, math.log2(max(2, n)) / 16)) << max(0, seed - 1)
    lists, inner = start(nodes, dim, n, seed, orders), None
    if before is not None:
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        split = ws.save(before.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sim", (F.col("a_in") == F.col("b_in")).alias("own")), f"{name}-split")
        inner, lists = split.where("own").drop("own"), lists.union(split.where("not own").drop("own"))
    lists = ws.save(best(lists, k), f"{name}-0")
    for p in range(1, passes + 1):
        lists = ws.save(best(lists.union(refine(lists, inner, nodes, k, near)), k), f"{name}-{p}")
        ws.drop(f"{name}-{p - 1}")
    return lists, inner


def exact(pairs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), a < b, whose cosine in double precision reaches ``least``."""
    x = pairs.join(units.select(F.col("node").alias("a"), F.col("unit").alias("ua")), "a")
    x = x.join(units.select(F.col("node").alias("b"), F.col("unit").alias("ub")), "b").select("a", "b", "ua", "ub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sim = np.einsum("ij,ij->i", _matrix(b.column("ua"), np.float64), _matrix(b.column("ub"), np.float64))
                keep = sim >= least
                yield _edges(b.column("a").to_numpy()[keep], b.column("b").to_numpy()[keep], sim[keep])

    return x.mapInArrow(run, _EDGES)


def audit(nodes: DataFrame, least: float, seed: int, sample: int) -> tuple[float, DataFrame]:
    """Recall of the links of sampled nodes, which are compared with all nodes, and those links (a, b).

    ``nodes`` holds node, component, unit. A link counts as found if its ends share a component, as the links of components are
    counted exactly. Recall is the lesser of that over all links and that averaged over the sampled nodes that have links.
    """
    spark = nodes.sparkSession
    rows = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").select("node", "component", "unit").limit(sample).collect()
    ids, within, q = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([np.frombuffer(r[2]) for r in rows])
    sent = spark.sparkContext.broadcast((ids, within, q))  # at most `sample` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, within, q = sent.value
        for b in batches:
            if b.num_rows and len(q):
                s = q @ _matrix(b.column("unit"), np.float64).T
                x, y = np.nonzero(s >= least)
                other, hit = b.column("node").to_numpy()[y], within[x] == b.column("component").to_numpy()[y]
                away = ids[x] != other
                n, hits = np.bincount(x[away], minlength=len(ids)), np.bincount(x[away & hit], minlength=len(ids))
                some, miss = np.flatnonzero(n), np.flatnonzero(~hit)
                nulls, zeros = pa.nulls(len(some), pa.int64()), pa.array(np.zeros(len(miss), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), nulls, pa.array(n[some]), pa.array(hits[some])], names)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x[miss]]), pa.array(other[miss]), zeros, zeros], names)

    names = ["a", "b", "n", "hit"]  # either a missed link, or a batch's numbers of links and of found ones
    true = nodes.select("node", "component", "unit").mapInArrow(run, "a long, b long, n long, hit long")
    each = true.groupBy("a").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    n, hit, mean = each.agg(F.sum("n"), F.sum("hit"), F.avg(F.col("hit") / F.col("n"))).first()
    return (min(hit / n, mean) if n else 1.0), true.where("b is not null").select("a", "b")


def counted(members: DataFrame, least: float) -> DataFrame:
    """(node, links): for members (node, component, copies, unit) how many vectors of the component each node links with.

    Nodes are dealt to blocks of about BLOCK; each pair of blocks of a component is one group, which
    passes on a count for each node only.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    rows = join_few(members, sizes, "component", "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "copies", "unit", "component", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "component", "x", "y")  # else the groups of a component would stay in one task

    def run(t: pa.Table) -> pa.Table:
        node, copies, block, u = t.column("node").to_numpy(), t.column("copies").to_numpy(), t.column("block").to_numpy(), _matrix(t.column("unit").combine_chunks(), np.float64)
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        i, j = np.flatnonzero(block == x), np.flatnonzero(block == y)
        links = np.zeros(len(node), np.int64)
        for p in range(0, len(i), 1024):
            near = u[i[p : p + 1024]] @ u[j].T >= least
            if x == y:
                near[np.arange(near.shape[0]), np.arange(p, p + near.shape[0])] = False
            links[i[p : p + 1024]] += near @ copies[j]
            if x != y:
                links[j] += copies[i[p : p + 1024]] @ near
        return pa.table({"node": node, "links": links})

    return rows.groupBy("component", "x", "y").applyInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def compare_rest(nodes: DataFrame, least: float, block: int = REST) -> DataFrame:
    """(a, b): links between components that, with those inside, connect whatever is linked, by comparing all nodes (node, component, unit) in pairs of blocks."""
    blocks = max(1, -(-nodes.count() // block))
    rows = nodes.select("node", "component", "unit", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(blocks)).cast("int").alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other")

    def run(t: pa.Table) -> pa.Table:
        node, block, u = t.column("node").to_numpy(), t.column("block").to_numpy(), _matrix(t.column("unit").combine_chunks(), np.float64)
        _, group = np.unique(t.column("component").to_numpy(), return_inverse=True)
        i, j = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        label, a, b = np.arange(group.max() + 1), [node[:0]], [node[:0]]
        for p in range(0, len(i), 256):
            x, y = np.nonzero(u[i[p : p + 256]] @ u[j].T >= least)
            x, y = i[p + x], j[y]
            g, h = label[group[x]], label[group[y]]
            _, first = np.unique(np.minimum(g, h) * len(label) + np.maximum(g, h), return_index=True)
            first = first[g[first] != h[first]]  # one link of each two components not connected yet
            a.append(node[x[first]]), b.append(node[y[first]])
            label = spanning(len(label), [(np.arange(len(label)), label), (g[first], h[first])])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "x", "y").groupBy("x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, k: int = K) -> DataFrame:
    """vec_id, n_links, component_id (the smallest vec_id reachable by links), kept."""
    spark = vectors.sparkSession
    ws = Workspace(spark)
    rows = ws.save(prepare(vectors), "rows")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("code").alias("code"))
    classes = ws.save(classes.withColumn("node", F.xxhash64("key")), "classes")
    dims = [r[0] for r in classes.select(F.octet_length("code").alias("d")).distinct().collect()]  # lengths of vectors
    every, counts = None, None
    for dim in dims:
        nodes = ws.read("classes", classes).where(F.octet_length("code") == dim)
        found, links = _linked(nodes, ws, dim, least, k)
        every = found if every is None else every.union(found)
        counts = links if counts is None else counts.union(links)
    if every is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    table = classes.join(every, "node", "left").join(counts, "node", "left").select("key", "rep", "copies", F.coalesce("component", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least_id = classes.join(every, "node").groupBy(F.col("component").alias("root")).agg(F.min("rep").alias("least"))
    table = join_few(table, ws.save(least_id, "least"), "root", "left").select("key", F.coalesce("least", "rep").alias("component_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    table = ws.save(table, "table")
    out = rows.join(table, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(nodes: DataFrame, ws: Workspace, dim: int, least: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(node, component) of linked nodes, and (node, links) with the number of other vectors that each links with."""
    edges, found, lists, slack = None, None, None, least - SLACK
    labelled = nodes.select("node", "code", "unit", F.col("node").alias("component"))
    for turn in range(MOST_ROUNDS + 1):
        name = f"d{dim}-{turn}"
        if turn < MOST_ROUNDS:
            lists, inner = descend(labelled.select("node", "component", "code"), lists, ws, name, dim, seed=turn, k=k, near=slack)
            near = lists.where(F.col("sim") >= slack)
            new = exact(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes, least).select("a", "b")
            full = not near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= k).isEmpty()
            lists = lists if inner is None else ws.save(lists.union(inner), f"{name}-lists")
        else:
            _log.warning("op4: comparing all vectors in blocks, as the audited recall is below %s", RECALL)
            new = compare_rest(labelled, least)
        edges = ws.save(new if edges is None else edges.union(new), f"{name}-edges")
        found = ws.save(components(ws, edges, f"{name}-c"), f"{name}-found")
        if turn == MOST_ROUNDS:
            break
        labelled = nodes.join(found, "node", "left").select("node", "code", "unit", F.coalesce("component", "node").alias("component"))
        labelled = ws.save(labelled, f"{name}-labelled")
        recall, missed = audit(labelled, least, turn, AUDIT)
        _log.info("op4: turn %d, audited recall %.4f", turn, recall)
        if recall >= RECALL and (turn or not full):
            break
        edges = ws.save(edges.union(missed), f"{name}-edges2")  # the next audit samples other nodes
    members = found.join(nodes.select("node", "copies", "unit"), "node")
    return found, ws.save(counted(members, least), f"d{dim}-links")

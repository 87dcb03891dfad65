"""SimHash near-duplicates found with vantage points in Hamming space.

A level of the tree has vantage points that differ from each other in half of the bits, like the rows of a
Hadamard matrix: two on the first level, four on the second. Their distances to a fingerprint say how far it is
from the first of them within each half, or quarter, of the bits, and these form its cell. By the triangle
inequality, taken over all vantage points of the level, two fingerprints at distance r or less lie in cells whose
coordinates differ by r at most in sum. So each fingerprint visits its own cell and the overlapping ones on one side (of two
cells the later one is visited). A cell's natives are dealt to blocks and its visitors to salts by their counted
numbers, and each block meets each salt in one task of bounded size. Inside of a task the quarters prune
whole branches by the same bound before pairs are compared exactly. A task passes on a spanning forest of its
links, which keeps components whole without spelling out all pairs of a group of copies.

Bounds of distance prune little among random fingerprints: of all pairs about 36 % are left by the first
level and 13 % by the second. More than MANY fingerprints therefore begin at the second level.

``keep_one`` is for similarity of shingles: Jaccard FIFTHS / 5 or more. There fingerprints have 128 bits, of which similar sets
differ in about 20 and hardly ever in more than NEAR, while others differ in 64. All distances from a fixed vantage point are near 64
too and bound nothing at such a radius, so the first level has the empty text: its distance from a set is the set's size, and sizes
of similar sets differ by a quarter at most, so cells are bands of sizes, which overlap. On the second level, inside of a task, vantage points are
fingerprints of the data: natives near one are its ball, and visitors that by the triangle inequality are too far from all of a ball are
not compared with it. So groups of near copies are kept apart, while texts like no other are in no ball and meet all. Pairs found are candidates, and their shingles decide: first each
candidate meets a few partners, whatever the size of its group, and those found similar become components; then all candidates that
are in different components yet are compared.

Defined cases: a null text is the empty text; texts without words have fingerprint zero and link like
any other; equal fingerprints are compared once, whatever their number; a null doc_id stays a row, has
no say in the smallest doc_id, and gets its group's; ``keep_one`` keeps the row of least doc_id (null last) of each component, one
row if several have it, with all its columns, and a text of fewer words is one shingle; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import BROADCAST_IDS, Workspace, batch_rows, components, join_few, spanning

#: Words of a shingle, differing bits of a link.
SHINGLE, RADIUS = 4, 4
#: The first vantage point; the others of a level have the bits of some halves or quarters flipped.
VANTAGE = 0x0F1E2D3C4B5A6978
#: Distinct fingerprints from which the second level is used.
MANY = 1 << 21
#: Natives of a block and visitors of a salt at most, about; pairs from which a task is split into branches.
NATIVES, VISITORS, BRANCH_PAIRS = 100_000, 30_000, 4_000_000
#: For ``keep_one``: words of a shingle, least Jaccard similarity in fifths, differing bits of 128, the same where sets of fewer than SHORT shingles take part, turns in which a candidate meets few partners, parts of a group that choose theirs by themselves, and parts of the hashes whose shingles are counted.
WORDS, FIFTHS, NEAR, NEAR_SHORT, SHORT, TURNS, PARTS, BUCKETS = 5, 4, 46, 52, 6, 2, 8, 256
#: Vantage points of a round, differing bits from one in its ball, natives that make a ball, and the part of a round's natives that balls must take for another round.
POINTS, BALL, FEW, WORTH = 32, 20, 8, 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64 bits, each set if set in over half of the XXH64 (seed 42) of the text's k-word shingles."""
    words = (text or "").encode().lower().split()  # bytes: ASCII white space and A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - k + 1)
    last = ends[k - 1 :] if len(words) >= k else ends[-1:]
    h = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64, n)
    return int(majority(h))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each whole text."""
    batch_rows(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), k) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _quarters(x: np.ndarray) -> np.ndarray:
    """Distances from the vantage point within each quarter of the bits."""
    y = x ^ np.uint64(VANTAGE)
    return np.stack([np.bitwise_count((y >> np.uint64(16 * q)) & np.uint64(0xFFFF)) for q in range(4)], 1).astype(np.int16)


def _branches(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints by their quarter distances: (distances, indices)."""
    q = _quarters(x)
    key = q.astype(np.int64) @ np.array([1, 32, 1024, 32768])
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    return [(q[i[0]], i) for i in np.split(order, cut)] if len(x) else []


def _compare(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, 400_000 // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        if len(x):
            yield x + i, y


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs of a and b at distance radius or less, block by block; branches are pruned if there are many pairs."""
    if len(a) * len(b) <= BRANCH_PAIRS:
        yield from _compare(a, b, radius)
        return
    left, right = _branches(a), _branches(b)
    far = np.stack([d for d, _ in right])
    for d, i in left:
        for k in np.flatnonzero(np.abs(far - d).sum(axis=1) <= radius):
            j = right[k][1]
            for x, y in _compare(a[i], b[j], radius):
                yield i[x], j[y]


def offsets(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of cells that can hold linked fingerprints, one of each pair of opposite ones."""
    every: list[tuple[int, ...]] = [()]
    for _ in range(blocks):
        every = [(*o, x) for o in every for x in range(-radius, radius + 1) if sum(map(abs, o)) + abs(x) <= radius]
    return [o for o in every if o > (0,) * blocks]


def dealt(natives: DataFrame, visits: DataFrame, per_block: int | None = None, per_salt: int | None = None) -> DataFrame:
    """Rows of both kinds (columns of ``visits``, and native) once for each task (cell, block, salt) that they take part in.

    Natives and visitors of each cell are counted (a row a cell, of which there are a bounded number); cells without natives drop out.
    """
    per_block, per_salt = per_block or NATIVES, per_salt or VISITORS
    n = natives.groupBy("cell").agg(F.count("*").alias("n"))
    v = visits.groupBy("cell").agg(F.count("*").alias("v"))
    cells = n.join(v, "cell").select("cell", F.ceil(F.col("n") / per_block).cast("int").alias("blocks"), F.ceil(F.col("v") / per_salt).cast("int").alias("salts"))
    cells = F.broadcast(cells)  # at most 65 ** 2 or 17 ** 4 cells, or a band for each quarter more of size
    part = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    home = natives.join(cells, "cell").withColumn("block", part("blocks")).withColumn("salt", each("salts")).withColumn("native", F.lit(True))
    away = visits.join(cells, "cell").withColumn("salt", part("salts")).withColumn("block", each("blocks")).withColumn("native", F.lit(False))
    parts = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return home.unionByName(away).drop("blocks", "salts").repartition(parts, "cell", "block", "salt")


def links(fps: DataFrame, ws: Workspace, radius: int = RADIUS, levels: int = 0) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span the components at this radius."""
    blocks = 2 ** (levels or (1 if fps.count() < MANY else 2))
    width = 64 // blocks
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(VANTAGE))).bitwiseAND(F.lit(signed(((1 << width) - 1) << width * k)))) for k in range(blocks)]
    fps = fps.select(F.col("fp").alias("node"), F.array(*far).alias("far"))
    packed = lambda cell: F.aggregate(cell, F.lit(0), lambda a, x: a * 65 + x)
    at = lambda o: F.array(*((F.get("far", F.lit(k)) + x).cast("int") for k, x in enumerate(o)))
    near = F.filter(F.array(*map(at, [(0,) * blocks, *offsets(blocks, radius)])), lambda c: F.forall(c, lambda x: x.between(0, width)))
    natives = fps.select("node", packed(F.col("far")).alias("cell"))
    visits = fps.select("node", F.explode(F.transform(near, packed)).alias("cell"))

    def search(table: pa.Table) -> pa.Table:
        fp = table.column("node").to_numpy().view(np.uint64)
        native = table.column("native").to_numpy(zero_copy_only=False)
        a, b = fp[native], fp[~native]
        both = np.concatenate([a, b])
        label = spanning(len(both), ((x, y + len(a)) for x, y in near_pairs(a, b, radius)))
        other = np.flatnonzero(both[label] != both)
        return pa.table({"a": both[label[other]].view(np.int64), "b": both[other].view(np.int64)})

    return ws.save(dealt(natives, visits).groupBy("cell", "block", "salt").applyInArrow(search, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links) of each row."""
    ws = Workspace(docs.sparkSession)
    own = ws.save(fingerprints(docs, k), "fingerprints")
    fps = ws.save(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = ws.save(components(ws, links(fps, ws, radius), "fp"), "found")
    member = fps.join(found, fps.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = found.join(fps, fps.fp == found.node).groupBy(F.col("component").alias("root")).agg(F.min("rep").alias("least"))
    group = join_few(member, ws.save(least, "least"), "root", "left").select("fp", F.when(F.col("least").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return own.join(ws.save(group, "groups"), "fp").select("doc_id", "fp", "component_id")


def op6(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles, mixed from those of its words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII white space and A-Z only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=42), words), np.uint64, n)
    x = np.zeros(max(1, n - k + 1), np.uint64)
    for i in range(min(k, n)):
        x = mixed(x) + h[i : i + len(x)]
    return np.unique(mixed(x))


def mixed(x: np.ndarray, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A bijection of 64 bits in which each bit of the input changes about half of the bits."""
    x = x + np.uint64(by)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray) -> np.uint64:
    """64 bits, each set if set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches FIFTHS / 5."""
    both = len(np.intersect1d(a, b, assume_unique=True)) if 5 * min(len(a), len(b)) >= FIFTHS * max(len(a), len(b)) else 0
    return 5 * both >= FIFTHS * (len(a) + len(b) - both)


def held(h: np.ndarray) -> bytes:
    """How many of the hashes each bucket holds; all buckets are full, which bounds nothing, if one would be."""
    n = np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return np.where(n.max() < 0xFFFF, n, 0xFFFF).astype("<u2").tobytes()


def may_be_similar(counts: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs of rows (x, y), whether their sets can be similar by their bucket counts, whose minima bound what they share."""
    out = [np.zeros(0, bool)]
    for i in range(0, len(x), 1 << 14):
        p, q = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
        both = np.minimum(np.minimum(counts[p], counts[q]).sum(axis=1, dtype=np.int64), np.minimum(size[p], size[q]))
        out.append(5 * both >= FIFTHS * (size[p] + size[q] - both))
    return np.concatenate(out)


def apart(prints: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the 128-bit fingerprints of rows x (down) and y (across)."""
    out = np.bitwise_count(prints[0][x, None] ^ prints[0][None, y])
    out += np.bitwise_count(prints[1][x, None] ^ prints[1][None, y])
    return out


def balls(prints: tuple[np.ndarray, np.ndarray], a: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows a dealt by vantage points, which are rows of least rank: (rows, vantage points, least and greatest distance from each).

    A ball has the rows within BALL of a vantage point that is their nearest. The others get vantage points of their own as long as balls
    take a part of them worth a round; what is left in the end is the last of the groups. Rows keep their order.
    """
    while len(a):
        v = a[np.argsort(rank[a], kind="stable")[:POINTS]]
        d = apart(prints, a, v)
        near = np.where(d.min(axis=1) <= BALL, d.argmin(axis=1), -1)
        n = np.bincount(near + 1, minlength=len(v) + 1)[1:]
        near[(near >= 0) & (n[near] < FEW)] = -1
        last = (near >= 0).sum() * WORTH < len(a)
        for k in np.unique(near):
            own = near == k
            if k >= 0 or last:
                yield a[own], v, d[own].min(axis=0), d[own].max(axis=0)
        if last:
            return
        a = a[near < 0]


def met(prints: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, rank: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of rows a, each with the rows b that can be within the radius of one of them; all at once if there are few pairs."""
    if len(a) * len(b) <= BRANCH_PAIRS:
        yield a, b
        return
    for own, v, least, greatest in balls(prints, a, rank):
        d = np.concatenate([apart(prints, b[i : i + 10_000], v) for i in range(0, len(b), 10_000)]).astype(np.int16)
        yield own, b[((d + radius >= least) & (d - radius <= greatest)).all(axis=1)]


_SETS = "_row long, id long, node long, size long, f0 long, f1 long, held binary"


def sets_of(rows: DataFrame) -> DataFrame:
    """Of each whole text (_row, doc_id, text) the node (of equal sets of shingles), the set's size and 128-bit fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, f0, f1, counts = [], [], [], [], []
            for t in b.column(2):
                x = shingles(t.as_py())
                node.append(xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63))
                size.append(len(x))
                f0.append(majority(x))
                f1.append(majority(mixed(x, 0x632BE59BD9B4E019)))
                counts.append(held(x))
            prints = (pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f0, f1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), *prints, pa.array(counts, pa.binary())], [c.split()[0] for c in _SETS.split(", ")])

    return rows.selectExpr("_row", "cast(doc_id as long) id", "text").mapInArrow(run, _SETS)


def candidates(sets: DataFrame, turn: int, every: bool = False) -> DataFrame:
    """Pairs (a, b) of nodes (node, size, f0, f1, component, held) of different components whose sizes, fingerprints and bucket counts allow for similarity.

    Of each node's partners in a task one is passed on, that of least hash, which differs by the turn and among PARTS parts of the nodes;
    so a group's nodes meet few others. With ``every`` all pairs are passed on.
    """
    band = F.floor(F.log("size") / np.log(1.26)).cast("int")
    sets = sets.where("size > 0").withColumn("cell", band)
    visits = sets.withColumn("cell", F.explode(F.array("cell", F.col("cell") + 1)))
    names = ["node", "size", "f0", "f1", "component", "held"]

    def search(t: pa.Table) -> pa.Table:
        native = t.column("native").to_numpy(zero_copy_only=False)
        node, size, f0, f1, group = (t.column(c).to_numpy() for c in names[:-1])
        counts = np.frombuffer(b"".join(t.column("held").to_pylist()), "<u2").reshape(-1, BUCKETS)
        prints, ids = (f0.view(np.uint64), f1.view(np.uint64)), node.view(np.uint64)
        near = NEAR_SHORT if len(size) and size.min() < SHORT else NEAR
        by_size = np.argsort(size, kind="stable")
        natives, visitors = by_size[native[by_size]], by_size[~native[by_size]]
        rank = np.stack([mixed(ids, turn * PARTS + p + 1) for p in range(PARTS)])
        part, mine = (mixed(ids, 99) % np.uint64(PARTS)).astype(int), mixed(ids, turn)
        # of each row as a visitor, and as a native, the partner of least hash
        best = [(np.full(len(node), 0xFFFFFFFFFFFFFFFF, np.uint64), np.full(len(node), -1)) for _ in range(2)]
        out: list[tuple[np.ndarray, np.ndarray]] = [(node[:0], node[:0])]
        for a, b in met(prints, natives, visitors, rank[0], near):
            step = max(1, 400_000 // max(1, len(a)))
            for i in range(0, len(b), step):
                y = b[i : i + step]
                low, high = np.searchsorted(size[a], [-(-FIFTHS * size[y[0]] // 5), 5 * size[y[-1]] // FIFTHS + 1])
                p, q = np.nonzero(apart(prints, y, a[low:high]) <= near)
                p, q = y[p], a[low + q]
                keep = (group[p] != group[q]) & (5 * np.minimum(size[p], size[q]) >= FIFTHS * np.maximum(size[p], size[q]))
                p, q = p[keep], q[keep]
                keep = may_be_similar(counts, size, p, q)
                p, q = p[keep], q[keep]
                if every:
                    out.append((node[p], node[q]))
                    continue
                for (least, whom), x, other, hashed in ((best[0], p, q, rank[part[p], q]), (best[1], q, p, mine[p])):
                    first = np.lexsort((hashed, x))
                    first = first[np.concatenate([[True], x[first][1:] != x[first][:-1]])] if len(x) else first
                    first = first[hashed[first] < least[x[first]]]
                    least[x[first]], whom[x[first]] = hashed[first], other[first]
        for _, whom in best:
            own = np.flatnonzero(whom >= 0)
            out.append((node[own], node[whom[own]]))
        x, y = (np.concatenate([o[k] for o in out]) for k in range(2))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return dealt(sets.select("cell", *names), visits.select("cell", *names)).groupBy("cell", "block", "salt").applyInArrow(search, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar; ``texts`` holds (node, text), a text for each node."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != at:  # rows of one b mostly follow each other
                    at, own = b, shingles(y.as_py())
                keep.append(similar(shingles(x.as_py()), own))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def similar_sets(sets: DataFrame, texts: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) of the nodes (node, size, f0, f1, held) that are linked: Jaccard of their shingles FIFTHS / 5 or more."""
    sets, edges = sets.withColumn("component", F.col("node")), None
    for turn in range(TURNS + 1):
        pairs = ws.save(candidates(sets, turn, every=turn == TURNS), f"pairs{turn}")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if not turn:  # what has no candidate now will have none later
            sets = ws.save(join_few(sets, ws.save(ends, "ends"), "node", "left_semi"), "likely")
            texts = ws.save(join_few(texts, ws.read("ends", ends), "node", "left_semi"), "texts")
        new = ws.save(verified(pairs, texts), f"links{turn}")
        edges = new if edges is None else edges.union(new)
        found = ws.save(components(ws, edges, f"c{turn}"), f"found{turn}")
        sets = ws.save(sets.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), f"labelled{turn}")
        if pairs.isEmpty():
            break
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of similar documents, that of least doc_id."""
    batch_rows(docs.sparkSession, 1000)
    ws = Workspace(docs.sparkSession)
    rows = ws.save(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    own = ws.save(sets_of(rows), "sets")
    least = F.min(F.struct(F.col("id").isNull(), "id", "_row")).alias("least")
    nodes = ws.save(own.groupBy("node", "size", "f0", "f1").agg(least, F.first("held").alias("held")).select("*", F.col("least._row").alias("_row")), "nodes")
    texts = rows.select("_row", "text").join(nodes.select("_row", "node"), "_row").select("node", "text")
    found = similar_sets(nodes.select("node", "size", "f0", "f1", "held"), texts, ws)
    alone = nodes.join(found, "node", "left_anti").select("_row")
    first = found.join(nodes, "node").groupBy("component").agg(F.min("least").alias("least")).select("least._row")
    first = ws.save(alone.union(first), "first")
    return rows.join(F.broadcast(first) if first.count() <= BROADCAST_IDS else first, "_row", "left_semi").select(*docs.columns)

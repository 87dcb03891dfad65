"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source's target is its weighted share of the words to take, at most ``most`` times what it has; what
is over is shared out again by weight (the water level is found by one pass over sources in the order in
which they fill up). A source's weight at time t of training, 0 to 1, is target * (1 + ramp * (2t - 1)); its
integral, the cumulative demand, is inverted for the middle of each document's copy in its source's stream
of words, and documents are range-sorted by that position.

A stream's order is the md5 of doc_id. Running sums are made in two levels (sums of hash ranges, then inside
each range), so that a source with a third of all rows is spread over as many tasks as any other.

Defined cases: a null text has size 0; a null source is a source of its own, the last; a null doc_id
counts as the empty text when streams are ordered; repeated rows are taken as often as they are there;
ties in the order have equal rows and so equal results; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import BROADCAST_IDS, Workspace

WEIGHTS = (3, 1, 2)
#: Change of weight over the curriculum by source in turn: from 1 - ramp to 1 + ramp times its mean.
RAMPS = (-0.5, 0.0, 0.5)
SHARE, MOST = 1.5, 2
WORDS = r"[^\x20\x09-\x0D]+"


def turn(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), ((rank - 1) % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, ramps: tuple = RAMPS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, ramp from (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # sources only, not rows
    sources = sources.select("source", "source_size", rank.alias("rank"), F.sum("source_size").over(Window.partitionBy()).alias("all"))
    sources = sources.select("source", "source_size", "rank", "all", turn(weights, F.col("rank")).alias("w"), turn(ramps, F.col("rank")).alias("ramp"))
    cap = F.col("source_size") * most
    fills = Window.orderBy(cap / F.col("w"), "rank")
    before = F.coalesce(F.sum(cap).over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(fills.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.select("*", (cap / F.col("w")).alias("full"), ((F.col("all") * share - before) / left).alias("level"))
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "rank", "level"))).over(Window.partitionBy())["level"]
    return sources.select("source", "source_size", "ramp", F.least(F.col("w") * level, cap.cast("double")).alias("target"))


def position(middle: Column, total: Column, ramp: Column) -> Column:
    """The time at which a source's cumulative demand reaches ``middle`` words of ``total``."""
    u = F.least(middle / F.greatest(total, F.lit(1e-9)), F.lit(1.0))
    root = F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u)
    return F.when(ramp == 0, u).otherwise((root - (1 - ramp)) / F.when(ramp == 0, F.lit(None)).otherwise(2 * ramp))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, ramps: tuple = RAMPS, share: float = SHARE, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, and the positions of the copies in training; and the columns of ``keep``."""
    ws = Workspace(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    rows = ws.save(docs.select("doc_id", "source", size.alias("size"), *keep), "sizes")
    per = ws.save(targets(rows, weights, ramps, share, most), "targets")
    ranges = 1 << max(4, min(16, math.ceil(math.log2(max(2, rows.count())) / 2)))  # so that there are about as many ranges as rows in one
    rows = rows.join(per, rows.source.eqNullSafe(per.source)).drop(per.source)
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("_h", digest).withColumn("_range", (F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * ranges / 65536).cast("int"))
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("_source"), F.col("_range").alias("_r"), ahead.alias("_ahead"))
    inside = Window.partitionBy("source", "_range").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_within", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(sums, rows.source.eqNullSafe(sums._source) & (rows._range == sums._r))
    middles = [F.col("_ahead") + F.col("_within") + F.col("size") / 2 + F.col("source_size") * k for k in range(most)]
    took = [m < F.col("target") for m in middles]
    copies = sum((t.cast("int") for t in took), F.lit(0))
    places = F.array(*(F.when(t, F.round(position(m, F.col("target"), F.col("ramp")), 9)) for m, t in zip(middles, took, strict=True)))
    return rows.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), places.alias("positions"), *keep)


def op5(docs: DataFrame) -> DataFrame:
    """One row a document, range-sorted by the position of its first copy; untaken documents come last."""
    out = mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.col("positions")[0].alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS w, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][(rank - 1) % 3 + 1] AS ramp,
         2 * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS want
  FROM s),
f AS (
  SELECT *, cap::DOUBLE / w AS filled,
         (want - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w),
t AS (
  SELECT source, source_size, ramp,
         least(w * (SELECT level FROM f WHERE level <= filled ORDER BY filled, rank LIMIT 1), cap::DOUBLE) AS target
  FROM f),
c AS (
  SELECT d.*, t.source_size, t.target, t.ramp,
         (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::DOUBLE
         + size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, least(middle / greatest(target, 1e-9::DOUBLE), 1.0::DOUBLE) AS u FROM c)
SELECT doc_id, size, source_size, target,
       (size * ((middle < target)::INT + (middle + source_size < target)::INT))::BIGINT AS taken,
       CASE WHEN middle < target THEN abs(round(CASE WHEN ramp = 0 THEN u
            ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u) - (1 - ramp)) / (2 * ramp) END, 9)) END AS position
FROM p
"""


def mixed(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The documents of the mix with all their columns, each copy a row of its own, range-sorted by its position.

    Rows are numbered in a copy of the table, so that each has its own positions, whatever it shares with others.
    Places are few bytes a document: they are broadcast if counted to be few, else both sides are shuffled.
    """
    ws = Workspace(docs.sparkSession)
    rows = ws.save(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    drawn = mix(rows, most=most, keep=("_row",)).select("_row", F.filter("positions", lambda p: p.isNotNull()).alias("_places")).where(F.size("_places") > 0)
    drawn = ws.save(drawn, "places")
    rows = rows.join(F.broadcast(drawn) if drawn.count() <= BROADCAST_IDS else drawn, "_row")
    return rows.withColumn("_at", F.explode("_places")).orderBy("_at", "doc_id").select(*docs.columns)

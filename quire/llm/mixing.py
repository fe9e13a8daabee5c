"""Mixing sources to target weights.

Each source gets a target number of words by weight, capped at `most` times its size,
the excess reshared.  Documents get hash-random keys and are range-sorted by source and
key; running totals of their sizes come from two levels (totals of the range
partitions, then sums within each), so a hot source spreads over many partitions and no
window spans a source.  A source's documents are taken in key order up to its exact
budget; whole epochs are repeated before that.

A null text has size 0; a null source is a source of its own, after all others.  Equal
documents have equal keys and are ordered by doc_id.  Sources without words have target 0.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import durable, parallelism, sized

WORD = r"[^\x20\x09-\x0D]+"


def running_total(df: DataFrame, order: list[str], value: Column, name: str = "before") -> DataFrame:
    """Adds the sum of `value` over all rows that sort before each row; `order` should be unique.

    Range-partitions by `order`, sums per partition, then adds the totals of the
    partitions before.  The table of partition totals has one row per partition.
    """
    parts = parallelism(df.sparkSession)
    ranged = durable(df.withColumn("_value", value).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("_value").alias("_total"))
    earlier = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(earlier), "_part").withColumn(name, F.col("_earlier") + F.coalesce(F.sum("_value").over(within), F.lit(0))).drop("_value", "_part", "_earlier")


def targets(sources: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, target): `share` of all sizes by weight, none above `most` times its size.

    Weights repeat over the sources in order of code points, null last.  The level that
    all uncapped sources share is found by a few aggregates over the source table.
    """
    ranked = running_total(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], F.lit(1).cast("long"), "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = durable(ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most))).select("source", "source_size", "weight", "cap"))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    budget, capped, rest, weight = share * total, 0.0, share * total, None
    while True:
        # sources above the level are fixed at their caps; the level only rises
        level = None if weight is None else (rest / weight if weight else 0.0)
        above = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        got = s.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("c"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        new_capped, new_weight = got["c"] or 0.0, got["w"] or 0.0
        if weight is not None and (new_capped, new_weight) == (capped, weight):
            break
        capped, weight, rest = new_capped, new_weight, budget - new_capped
        if not weight:
            break
    share_of = F.lit(rest) * F.col("weight") / F.lit(weight or 1.0)
    return s.select("source", "source_size", F.when(F.lit(not weight) | (F.col("cap") < share_of), F.col("cap")).otherwise(share_of).alias("target"))


def plan(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, key, size, source_size, target, epochs, partial, before.

    `before` counts the words of the source that precede the document in key order;
    `partial` is what remains of the target after whole epochs.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    small = durable(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), size.alias("size"), key.alias("key")))
    goals = targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    ordered = running_total(small.withColumn("_null", F.col("source").isNull()), ["_null", "source", "key", "doc_id", "size"], F.col("size"), "all_before").drop("_null")
    bases = ordered.groupBy("source").agg(F.min("all_before").alias("base"))
    goals = goals.join(bases, goals["source"].eqNullSafe(bases["source"])).drop(bases["source"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("partial", F.floor("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_source")
    joined = ordered.join(sized(goals), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("before", F.col("all_before") - F.col("base")).drop("all_before", "base")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words the mix takes of each document.

    The document at a source's cut is taken in part, so a source's taken words are its
    target rounded down.
    """
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("partial") - F.col("before")))
    return plan(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mixed(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", seed: str = "mix", **options) -> DataFrame:
    """The documents of the mix, repeated as often as they are taken, with the columns they had.

    Documents aren't split: the one at the cut is taken whole if at least half of it
    lies within the budget.  Texts aren't shuffled: each source's cut is a key.
    """
    columns = docs.columns
    chosen = plan(docs, source=source, doc_id=doc_id, seed=seed, **options)
    inside = F.col("before") * 2 + F.col("size") <= F.col("partial") * 2
    last = F.struct("key", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"), "size")
    cuts = chosen.groupBy(F.col("source").alias("__q_source")).agg(F.max("epochs").alias("__q_epochs"), F.max(F.when(inside & (F.col("partial") > 0), last)).alias("__q_cut"))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    own = F.struct(key.alias("key"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.regexp_count(F.col(options.get("text", "text")), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    joined = docs.join(sized(durable(cuts)), F.col(source).eqNullSafe(F.col("__q_source")))
    copies = F.col("__q_epochs") + F.when(F.col("__q_cut").isNotNull() & (own <= F.col("__q_cut")), 1).otherwise(0)
    repeated = joined.withColumn("__q_copies", copies.cast("int")).where("__q_copies > 0")
    return repeated.withColumn("__q_copy", F.explode(F.sequence(F.lit(1), F.col("__q_copies")))).select(*[F.col(f"`{c}`") for c in columns])


#: DuckDB SQL of mix() over `documents`.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM s),
r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE AS budget
  FROM w),
k AS (
  SELECT capped, open, budget FROM r WHERE (budget - capped) / open <= cap / weight ORDER BY cap / weight, source LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN cap < (k.budget - k.capped) * weight / k.open THEN cap ELSE (k.budget - k.capped) * weight / k.open END AS target
  FROM r, k),
o AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM o
"""

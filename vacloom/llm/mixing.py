"""Mixing sources to target weights by entropy balancing.

Words are the units that are weighted. The rates closest in relative entropy to the corpus as it is,
under one token constraint per source, are ``rate = exp(lambda of the source)``; the convex dual is solved
by damped Newton steps on the gradient that the cluster has summed per source. All of this stays in
DataFrames: sources are rows, none is collected.

Rates become whole copies by systematic rounding along the sizes: classes of equal size within a source
get running totals of copies, what the rounding leaves is settled with the smallest documents, and within
a class the copies go to documents in a fixed order. So reruns agree and a source misses its target by less
than the size of one small document, unless its documents are too few to do better.

Defined results: a null text has size 0; null is a source like any other, last in order; sources whose
documents are all empty have target 0; repeated rows are documents of their own; an empty table gives no
rows. Other input columns are carried. Names starting with ``_m_`` are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacloom.llm.common import durable, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
NEWTON_STEPS = 60
SLICES = 64  # parts of a class of equal size, so that a class with a third of all rows is numbered in parts


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: its size and its target in words.

    Resharing the excess of capped sources by weight ends at ``min(cap * size, level * weight)``; the
    level follows from running sums over sources ordered by the level at which they reach their cap.
    """
    totals = sizes.groupBy("_m_source").agg(F.sum("_m_size").cast("long").alias("_m_total"))
    place = F.row_number().over(Window.orderBy(F.col("_m_source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int"))
    rows = totals.withColumn("_m_weight", weight).withColumn("_m_most", F.lit(float(cap)) * F.col("_m_total"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_m_most") / F.col("_m_weight"), F.col("_m_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_m_all": F.sum("_m_total").over(everything).cast("double"),
        "_m_capped": F.coalesce(F.sum("_m_most").over(before), F.lit(0.0)),
        "_m_open": F.sum("_m_weight").over(everything) - F.coalesce(F.sum("_m_weight").over(before), F.lit(0.0)),
    })
    rows = rows.withColumn("_m_level", (F.col("_m_all") - F.col("_m_capped")) / F.col("_m_open"))
    fits = F.when(F.col("_m_level") * F.col("_m_weight") <= F.col("_m_most"), F.col("_m_level"))
    level = F.coalesce(F.min_by(fits, F.when(fits.isNotNull(), F.col("_m_most") / F.col("_m_weight"))).over(everything), F.lit(float("inf")))
    return rows.withColumn("_m_final", level).select(
        "_m_source", "_m_total", F.least("_m_most", F.col("_m_final") * F.col("_m_weight")).alias("_m_target")
    )


def newton_rate(total: Column, target: Column, cap: int = CAP) -> Column:
    """``exp(lambda)`` where the dual's gradient ``total * exp(lambda) - target`` vanishes."""
    def step(lam: Column, _: Column) -> Column:
        gradient, curvature = total * F.exp(lam) - target, total * F.exp(lam)
        return lam - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gradient / curvature))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)
    return F.when((total > 0) & (target > 0), F.least(F.lit(float(cap)), F.exp(solved))).otherwise(F.lit(0.0))


def class_copies(classes: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """Copies for each class of equal size within a source, summing up to the source's target."""
    t = targets.select(F.col("_m_source").alias("_m_s"), "_m_total", "_m_target")
    rows = classes.join(t, F.col("_m_source").eqNullSafe(F.col("_m_s"))).drop("_m_s")
    rows = rows.withColumn("_m_rate", newton_rate(F.col("_m_total").cast("double"), F.col("_m_target"), cap))
    up = Window.partitionBy("_m_source").orderBy("_m_size").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.col("_m_n") * F.col("_m_rate")).over(up)
    rows = rows.withColumn("_m_upto", F.floor(running + 0.5))
    down = Window.partitionBy("_m_source").orderBy("_m_size")
    copies = F.col("_m_upto") - F.coalesce(F.lag("_m_upto").over(down), F.lit(0))
    rows = rows.withColumn("_m_copies", F.least(F.col("_m_n") * cap, copies))
    rows = rows.withColumn(
        "_m_left", F.col("_m_target") - F.sum(F.col("_m_copies") * F.col("_m_size")).over(Window.partitionBy("_m_source"))
    )
    spare = F.when(F.col("_m_left") > 0, F.col("_m_n") * cap - F.col("_m_copies")).otherwise(F.col("_m_copies"))
    rows = rows.withColumn("_m_spare", F.when(F.col("_m_size") > 0, spare).otherwise(0))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("_m_spare") * F.col("_m_size")).over(before), F.lit(0))
    wanted = F.floor((F.abs("_m_left") - used) / F.greatest(F.col("_m_size"), F.lit(1)) + 0.5)
    moved = F.greatest(F.lit(0), F.least(F.col("_m_spare"), wanted))
    return rows.select(
        "_m_source", "_m_size", "_m_n", "_m_total", "_m_target", "_m_rate",
        (F.col("_m_copies") + F.signum("_m_left").cast("long") * moved).cast("long").alias("_m_copies"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, slices: int = SLICES) -> DataFrame:
    """Add size, source_size, target, rate and copies to every document."""
    size = F.col("_m_size") if "_m_size" in docs.columns else word_count(docs["text"])
    rows = docs.withColumns({
        "_m_source": docs["source"], "_m_size": size,
        "_m_slice": F.pmod(F.xxhash64(docs["doc_id"]), F.lit(slices)).cast("int"),
    })
    # One scan of the texts serves both the sums and the counts of slices.
    counts = durable(rows.groupBy("_m_source", "_m_size", "_m_slice").agg(F.count(F.lit(1)).alias("_m_n")))
    words = counts.select("_m_source", (F.col("_m_n") * F.col("_m_size")).alias("_m_size"))
    targets = durable(source_targets(words, weights, cap))
    classes = class_copies(counts.groupBy("_m_source", "_m_size").agg(F.sum("_m_n").alias("_m_n")), targets, cap)
    earlier = Window.partitionBy("_m_source", "_m_size").orderBy("_m_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_m_shift", F.coalesce(F.sum("_m_n").over(earlier), F.lit(0))).drop("_m_n")
    plan = shifts.alias("a").join(
        classes.alias("b"),
        F.col("a._m_source").eqNullSafe(F.col("b._m_source")) & (F.col("a._m_size") == F.col("b._m_size")),
    ).select("a.*", "b._m_n", "b._m_total", "b._m_target", "b._m_rate", "b._m_copies")
    own = Window.partitionBy("_m_source", "_m_size", "_m_slice").orderBy("doc_id", F.xxhash64("_m_order"))
    numbered = rows.withColumn("_m_order", rows["text"] if "text" in docs.columns else F.lit("")).withColumn(
        "_m_rank", F.row_number().over(own)
    ).drop("_m_order")
    plan = plan.select(*[F.col(c).alias(f"{c}_p") for c in plan.columns])
    joined = numbered.join(
        plan,
        F.col("_m_source").eqNullSafe(F.col("_m_source_p")) & (F.col("_m_size") == F.col("_m_size_p"))
        & (F.col("_m_slice") == F.col("_m_slice_p")),
    )
    place = F.col("_m_rank") + F.col("_m_shift_p")
    each, extra = F.floor(F.col("_m_copies_p") / F.col("_m_n_p")), F.pmod("_m_copies_p", "_m_n_p")
    return joined.select(
        *[F.col(c) for c in docs.columns if not c.startswith("_m_")],
        F.col("_m_size").alias("mix_size"), F.col("_m_total_p").alias("mix_source_size"), F.col("_m_target_p").alias("mix_target"),
        F.col("_m_rate_p").alias("mix_rate"), (each + F.when(place <= extra, 1).otherwise(0)).cast("int").alias("mix_copies"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: every document as often as its copies say, with the columns it came with."""
    named = docs.columns
    rows = mixed(docs, weights, cap).filter("mix_copies > 0")
    return rows.withColumn("_m_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*named)

"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's part of the total, clamped at ``epochs``
times its own size; what clamping frees is shared by weight among the others
until none is above its clamp. That fixed point is min(clamp, level * weight)
for one water level: with the sources in ascending order of clamp / weight,
the clamped ones come first, and the level is (total - their clamps) / (weight
of the rest). One window over the table of sources (one row a source) finds it.

A source whose target is r times its size takes each document floor(r) times
and, for the fraction, once more those that come first in a seeded order
(md5 of seed and id) until their sizes fill the fraction. The fraction becomes
one cut-off hash a source, so documents are never ordered as a whole: sums by
source and bin of the hash (its first digits; summed map-side) name the one bin
on the edge, and only that bin's rows are ordered. Documents then meet a table
of one row a source, and no text is shuffled.

Defined cases: a null source is a source (last in order); a null or empty text
has size 0; a source of size 0 has target 0; rows that share an id are taken or
left together, and so are all rows with a null id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import saved, word_count

#: Bins of the seeded order: hash digits that name one (16 ** BIN_DIGITS bins a source).
BIN_DIGITS = 3


def source_targets(rows: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from rows with source and size.

    Sources in code-point order, null last, get ``weights`` in turn.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (n + 1).cast("int")).cast("long"))
    filled = Window.orderBy((F.col("clamp") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = (sources.withColumn("clamp", F.col("source_size") * epochs)
         .withColumn("clamps_before", F.sum("clamp").over(filled.rowsBetween(Window.unboundedPreceding, -1)))
         .withColumn("weight_left", F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("total", F.sum("source_size").over(every))
         .withColumn("level", (F.col("total") - F.coalesce("clamps_before", F.lit(0))) / F.col("weight_left"))
         # the level is the one seen by the first source that its clamp doesn't bind
         .withColumn("free", F.col("level") * F.col("weight") <= F.col("clamp")))
    level = F.max_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.col("weight_left"))).over(every)
    return s.withColumn("water", level).select(
        "source", "source_size",
        F.when(F.col("water").isNull() | (F.col("water") * F.col("weight") > F.col("clamp")), F.col("clamp").cast("double"))
        .otherwise(F.col("water") * F.col("weight")).alias("target"))


def _turn(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))


def _cutoffs(rows: DataFrame, epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """One row a source: size, target, whole repetitions, and the last hash that is taken once more.

    ``rows`` has source, size and turn.
    """
    rows = rows.withColumn("bin", F.substring("turn", 1, BIN_DIGITS))
    bins = saved(rows.groupBy("source", "bin").agg(F.sum("size").alias("size")), "mix-bins")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(epochs)))).otherwise(F.lit(0.0))
    targets = (source_targets(bins, epochs, weights).withColumn("whole", F.floor(rate).cast("int"))
               .withColumn("more", (rate - F.floor(rate)) * F.col("source_size"))
               .withColumnRenamed("source", "t_source"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = (bins.withColumn("bin_end", F.sum("size").over(upto))
             .join(targets, F.col("source").eqNullSafe(F.col("t_source")), "right")
             .groupBy("t_source", "source_size", "target", "whole", "more")
             # the first bin that ends beyond the fraction
             .agg(F.min(F.when(F.col("bin_end") > F.col("more"), F.struct("bin", (F.col("bin_end") - F.col("size")).alias("start")))).alias("edge")))
    edges = saved(edges.select("t_source", "source_size", "target", "whole", "more", F.col("edge.bin").alias("edge_bin"),
                               F.col("edge.start").alias("edge_start")), "mix-edges")
    inner = Window.partitionBy("t_source").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    edge_rows = (rows.join(edges, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("bin") == F.col("edge_bin")))
                 .groupBy("t_source", "turn", "edge_start", "more").agg(F.sum("size").alias("size"))
                 .withColumn("start", F.col("edge_start") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
                 .where(F.col("start") + F.col("size") / 2.0 < F.col("more"))
                 .groupBy(F.col("t_source").alias("c_source")).agg(F.max("turn").alias("last_turn")))
    cut = edges.join(edge_rows, F.col("t_source").eqNullSafe(F.col("c_source")), "left").drop("c_source", "edge_start", "more")
    # written, so that its size is known when the join with the documents is planned
    return saved(cut, "mix-cut")


def mix_plan(docs: DataFrame, seed: int = 17, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3),
             keep: list[str] | None = None, with_size: bool = True) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with size, source_size, target and times."""
    made = ["size"] * with_size + ["source_size", "target", "times"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    small = saved(docs.select(F.col("doc_id").alias("kept doc_id"), "source", word_count(F.col("text")).alias("size"), _turn(seed).alias("turn")), "mix-rows")
    if keep == ["doc_id"]:
        rows = small
    else:
        rows = docs.select(*[F.col(f"`{c}`").alias(f"kept {c}") for c in keep], "source",
                           *[word_count(F.col("text")).alias("size")] * with_size, _turn(seed).alias("turn"))
    cut = _cutoffs(small.select("source", "size", "turn"), epochs, weights)
    taken_once_more = F.coalesce(F.col("turn") <= F.col("last_turn"), F.lit(False)) | F.coalesce(
        F.substring("turn", 1, BIN_DIGITS) < F.col("edge_bin"), F.lit(False))
    return (rows.join(cut, F.col("source").eqNullSafe(F.col("t_source")))
            .withColumn("times", F.col("whole") + taken_once_more.cast("int"))
            .select(*[F.col(f"`kept {c}`").alias(c) for c in keep], *[F.col(c) for c in made]))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    columns = docs.columns
    body = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("taken row")
    plan = mix_plan(docs.select(body, "doc_id", "text", "source"), keep=["taken row"], with_size=False, **options)
    copies = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy number")
    return plan.where("times > 0").select("taken row", copies).select("taken row.*")

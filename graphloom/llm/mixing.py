"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

Every document draws an exponential key -ln(u) / w, where u is a hash of its id and w its quality weight;
the documents of a source in ascending order of key are a weighted sample without replacement. A source
whose target exceeds its size is first taken in whole as often as that fits (complete epochs); the rest of the
target is filled in the order of keys until the prefix sum of sizes meets it.

No source is ever sorted or gathered in one task. Keys fall into BINS bins by the quantile that an exponential of
mean weight gives them; sizes are summed by (source, bin) before the shuffle, the prefix sums of bins run over at
most BINS rows a source, and only the one bin of each source in which the target falls is sorted by row. That
gives each source a last row to take; with the plan, one row a source, in every task, rows are decided where they
are. Beyond PLAN_ROWS sources the plan isn't broadcast: rows are salted by SALTS and meet its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, unit_digest, word_count

BINS = 4096
#: Most rows of a plan that is broadcast, and salts of a source where it isn't.
PLAN_ROWS, SALTS = 20_000, 64
#: Weights of sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Quality weights by labels.quality; unlabelled documents have 1.
QUALITY = {0: 0.5, 1: 2.0}


def water_fill(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with its `target`: `share` of all sizes by weight, at most `most` times its size.

    What a capped source leaves is shared by weight among the others, until none is above its cap. The caps
    bind in order of size / weight, so the level is found by prefix sums instead of rounds: with the sources
    in that order, the level of source i is (total - caps before i) / (weights from i on), and the first
    source whose cap exceeds it ends the capped ones. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    capped = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    in_order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    after = in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = capped.withColumns(
        {
            "total": F.lit(share) * F.sum("source_size").over(everything),
            "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(after),
        }
    )
    level = (F.col("total") - F.col("spent")) / F.col("open")
    free = F.col("cap") / F.col("weight") >= level
    final = F.max(F.when(free, level)).over(everything)  # levels fall along the free sources: the first one's
    return filled.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * final, "cap")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of `docs` (doc_id, text, source).

    size counts `[^\\x20\\x09-\\x0D]+` runs (null text: 0), taken the words that the mix takes, repeats
    included. `quality` (doc_id, weight) scales the keys; absent or null weights count as 1, others must be
    above 0. Sources go by code point, null last. The row in which the target falls is taken if that brings
    the sum nearer to the target. Rows of size 0 take 0; equal rows share one key and follow each other.
    Reruns give the same rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"))
    if quality is not None:
        once = quality.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("weight").cast("double").alias("w")).groupBy("doc_id").agg(F.max("w").alias("w"))
        rows = rows.join(once, "doc_id", "left").withColumn("w", F.coalesce(F.when(F.col("w") > 0, F.col("w")), F.lit(1.0)))
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    draw: Column = -F.log(unit_digest("doc_id", seed=seed)) / F.col("w")
    rows = rows.withColumn("key", draw).withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * BINS).cast("int"))
    rows = materialize(rows, "draws")
    # one row a source and bin, summed before the shuffle
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    sizes = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = water_fill(sizes, share, most, weights)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    along = Window.partitionBy("source").orderBy("bin")
    cut = bins.withColumn("upto", F.sum("words").over(along)).join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    # the first bin whose prefix sum reaches the rest, and the words before it
    edge = cut.where("upto >= rest").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    plan = targets.join(edge.withColumnRenamed("source", "e"), F.col("source").eqNullSafe(F.col("e")), "left").select("source", "source_size", "target", "epochs", "rest", F.col("edge.bin").alias("edge_bin"), F.col("edge.before").alias("edge_before"))
    plan = materialize(plan, "plan")
    in_bin = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    place = F.struct("key", "doc_id", "size")
    tight = _with_plan(rows, plan).where(F.col("bin") == F.col("edge_bin")).withColumn("prefix", F.col("edge_before") + F.sum("size").over(in_bin.rowsBetween(Window.unboundedPreceding, 0)))
    # prefix - size / 2 never falls along the order: what is taken ends at one row
    last = tight.where(F.col("prefix") - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(place).alias("last"))
    ended = materialize(plan.join(last.withColumnRenamed("source", "e"), F.col("source").eqNullSafe(F.col("e")), "left").drop("e"), "plan")
    before = (F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & (place <= F.col("last")))
    copies = F.col("epochs") + (F.coalesce(before, F.lit(False)) & (F.col("rest") > 0) & (F.col("size") > 0)).cast("long")
    return _with_plan(rows, ended).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` with the plan's columns for their source; `plan` is a written table of one row a source."""
    plan = plan.withColumnRenamed("source", "plan_source")
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    if plan.count() <= PLAN_ROWS:
        return rows.join(F.broadcast(plan), same).drop("plan_source")
    salted = plan.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("key", "doc_id", "size"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("salt") == F.col("plan_salt"))).drop("plan_source", "plan_salt", "salt")


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels.quality: the least label's weight where a document has several."""
    weight = F.create_map(*[x for k, v in QUALITY.items() for x in (F.lit(k), F.lit(v))])[F.col("quality").cast("int")]
    return labels.where("doc_id is not null").select("doc_id", weight.alias("weight")).groupBy("doc_id").agg(F.min("weight").alias("weight"))


def repeat_mixed(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """`docs` with all its columns, each row as often as `mix` takes it; rows that it doesn't take go.

    Rows without words are no part of a mix of words and go too. Rows that share an id share the greater
    number.
    """
    copies = mix(docs, quality, **options).groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.col("copies"))).cast("int").alias("__graphloom_copies"))
    copies = copies.withColumnRenamed("doc_id", "__graphloom_id").where(F.col("__graphloom_copies") > 0)
    joined = docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(copies["__graphloom_id"]))
    return joined.withColumn("__graphloom_copy", F.explode(F.sequence(F.lit(1), F.col("__graphloom_copies")))).select(*docs.columns)

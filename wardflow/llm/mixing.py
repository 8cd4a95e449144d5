"""Mixing sources to target weights by capped water-filling, with seeded repetitions.

Targets.  The words wanted are shared over the sources by weight; a source stops at ``max_epochs``
times its size and what it can't take is shared by weight among the others, until no source is
above its cap.  Raising a common level, sources fill in the order of cap / weight; so the final
level follows from running sums over the sources in this order, without iterating.

Sampling.  A source whose target is e times its size gives each document floor(e) times, and once
more to documents in a seeded random order until the rest of the target is reached: a document
goes in if at least half of it fits.  The order's running sum is cut into slots: sums per slot
show in which slot a source's target falls, and only that slot's rows are sorted, by key and size alone.
What comes of it is one row per source, which the documents are joined with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.sources.scratch import written

#: A slot is so many leading hexadecimal digits of a document's random key.
SLOT_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Gives the sources of ``sizes``, by code point with null last, the weights in turn."""
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*(F.lit(float(w)) for w in weights))
    return sizes.withColumn("weight", F.get(values, (position % len(weights)).cast("int")))


def water_filled(sizes: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``source, source_size, weight`` with ``target``; one row per source.

    ``share`` of all sizes is wanted.  A weight that is null or not above 0 gets target 0.  Where
    ``share`` exceeds ``max_epochs``, every source is at its cap.
    """
    weighed = sizes.withColumn("w", F.when(F.col("weight") > 0, F.col("weight"))).withColumn(
        "cap", F.col("source_size") * F.lit(float(max_epochs))
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc_nulls_last(), F.col("source").asc_nulls_last())
    wanted = F.sum("source_size").over(everything) * F.lit(float(share))
    clamped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # the level if all sources before are full: it rises while that is so, and falls from the
    # first that isn't, so the final level is the highest
    levelled = weighed.withColumn("level", (wanted - clamped) / left)
    target = F.least(F.col("cap"), F.max("level").over(everything) * F.col("w"))
    return levelled.withColumn("target", F.when(F.col("w").isNull(), 0.0).otherwise(target)).select("source", "source_size", "weight", "target")


def _decisions(narrow: DataFrame, weights, share: float, max_epochs: int) -> DataFrame:
    """One row per source, written: its figures, and up to which row of its random order it goes in once more.

    ``narrow`` has ``of, size, key, slot``.  Rows of earlier slots than ``cut_slot`` go in, and those of
    that slot up to ``last``: the key and size of the last one, and how many rows with both.
    """
    slots = narrow.groupBy(F.col("of").alias("source"), "slot").agg(F.sum("size").alias("words"))
    sizes = slots.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = water_filled(cyclic_weights(sizes, weights), share, max_epochs)
    times = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))
    epochs = targets.withColumn("whole", F.when(F.col("source_size") > 0, times).otherwise(0)).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    ).withColumnRenamed("source", "in_source")
    # the slot in which each source's rest runs out, and the words before it
    running = slots.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("slot")) - F.col("words"))
    cut = (
        running.join(epochs, F.col("source").eqNullSafe(F.col("in_source")))
        .where("before <= rest")
        .groupBy("in_source", "source_size", "target", "whole", "rest")
        .agg(F.max("slot").alias("cut_slot"), F.max("before").alias("cut_before"))
    )
    cut = written(cut, "cut")
    there = F.col("of").eqNullSafe(F.col("in_source")) & (F.col("slot") == F.col("cut_slot"))
    inside = Window.partitionBy("of").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("cut_before") + F.sum("size").over(inside)
    at_cut = narrow.join(cut, there).withColumn("upto", upto)
    # what stands before a row's middle only grows, so those that go in are the first ones
    goes_in = at_cut.where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    last = goes_in.groupBy("of", "key", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("of").agg(F.max(F.struct("key", "size", "n")).alias("last"))
    found = cut.join(last, F.col("in_source").eqNullSafe(F.col("of")), "left")
    return written(found.select("in_source", "source_size", "target", "whole", "cut_slot", "last"), "decisions")


def _decided(
    documents: DataFrame, size: Column | None, weights, share: float, max_epochs: int, seed: int, sized: bool = True
) -> DataFrame:
    """Each row as the struct ``row``, with its source's figures beside it and, if ``sized``, its own size.

    Rows meet one row per source, which Spark broadcasts by the size of what was written: texts aren't shuffled.
    """
    size = n_words(F.col("text").cast("string")) if size is None else size
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    of, slot = F.col("source").alias("of"), F.conv(F.substring("key", 1, SLOT_DIGITS), 16, 10).cast("int")
    narrow = written(documents.select(of, size.alias("size"), key.alias("key")).withColumn("slot", slot), "sized")
    rows = documents.select(F.struct("*").alias("row"), of, key.alias("key"), *([size.alias("size")] if sized else []))
    own_size = F.col("size") if sized else n_words(F.col("row")["text"].cast("string"))
    decisions = _decisions(narrow, weights, share, max_epochs)
    joined = rows.withColumn("slot", slot).join(decisions, F.col("of").eqNullSafe(F.col("in_source")))
    # the size is looked at for the last row that goes in alone, and rows with its id
    is_last = F.coalesce((F.col("slot") == F.col("cut_slot")) & (F.col("key") == F.col("last.key")) & (own_size == F.col("last.size")), F.lit(False))
    same_key = F.when(F.col("key") == F.col("last.key"), own_size < F.col("last.size")).otherwise(F.col("key") < F.col("last.key"))
    first = (F.col("slot") < F.col("cut_slot")) | ((F.col("slot") == F.col("cut_slot")) & F.coalesce(same_key, F.lit(False)))
    decided = joined.where(~is_last).withColumn("more", first.cast("int"))
    equal = F.row_number().over(Window.partitionBy("of", "key").orderBy("key"))
    ties = joined.where(is_last).withColumn("more", (equal <= F.col("last.n")).cast("int"))
    copies = F.least(F.col("whole") + F.col("more"), F.lit(max_epochs)).cast("int")
    figures = ["size", "source_size", "target"] if sized else []
    return decided.unionByName(ties).select("row", *figures, copies.alias("copies"))


def mixed(
    documents: DataFrame,
    size: Column | None = None,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 7,
) -> DataFrame:
    """``documents`` with ``size, source_size, target, copies``; they replace columns named so.

    ``copies`` is how often the mix takes the row, at most ``max_epochs`` times.  ``size`` is the
    number of words unless given; null texts have none, and null sources are one source.  The
    random order is that of the hex digest of doc_id and seed, equal ones by size, so reruns agree
    and repeated rows are taken in turn.  An empty table gives an empty mix.
    """
    figures = ["size", "source_size", "target", "copies"]
    found = _decided(documents, size, weights, share, max_epochs, seed)
    own = [F.col("row")[c].alias(c) for c in documents.columns if c not in figures]
    return found.select(*own, *figures)


def repeated(
    documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 7
) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of ``documents``.

    Nulls, repeated rows and an empty table are as in ``mixed``; other columns pass as they are.
    """
    found = _decided(documents, None, weights, share, max_epochs, seed, sized=False)
    times = F.explode(F.expr("array_repeat(0, copies)"))
    return found.select("row", times.alias("copy")).select("row.*")

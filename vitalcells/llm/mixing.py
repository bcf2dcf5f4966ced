"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in shuffled order, as often as the source may be repeated. A copy's
virtual finish time is the number of its source's words up to its end, divided by the source's target;
copies of all sources are sorted by it and taken until the budget, the words of the whole input, is
used. At time 1 every source has given its target.

Running totals are made in two steps, within shares of the shuffled order (or of virtual time) of
bounded size and over the totals of these shares, so a source with most of the rows is spread like any
other. Everything is DataFrame work.

Defined results: null texts have size 0; documents of size 0 are never taken; null sources are one
source, the last in order. Repeated rows are taken independently; a null doc_id is a value like any
other. Where copies finish at the same time, source and position decide. An empty input gives no rows.
"""

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalcells.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 11
#: Rows that one task sorts for a running total.
SHARE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Words each source shall give: all sources together give the words of the input, shared by
    weight; a source gives at most `most` times its own, and the others share the rest.

    sizes has source and source_size, one row per source; its windows run over sources only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = (sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), number + 1))
               .withColumn("most", F.col("source_size") * most))
    # Sources reach their limit in order of limit over weight. Up to the first that does not, the
    # others' words are shared among those that follow.
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    leveled = (weighed.withColumn("level", (everything - before) / rest)
               .withColumn("place", F.row_number().over(order)))
    free = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("place"))
    first = F.min(free).over(Window.partitionBy())
    level = F.max(F.when(F.col("place") == first, F.col("level"))).over(Window.partitionBy())
    return (leveled.withColumn("first", first).withColumn("final", level)
            .select("source", "source_size",
                    F.when(F.col("place") >= F.col("first"), F.col("final") * F.col("weight"))
                    .otherwise(F.col("most")).cast("double").alias("target")))


def _shares(rows: int) -> int:
    return max(1, ceil(rows / SHARE_ROWS))


def _running(df: DataFrame, group: list[str], share: str, order: list, amount: str, name: str) -> DataFrame:
    """Running totals of `amount` by group, over shares in order and within each of them."""
    # Null-safe keys, as a source may be null.
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k_{c}") for c in group]
    flags = [F.col(c).isNull().alias(f"n_{c}") for c in group]
    on = [f"{p}_{c}" for c in group for p in "kn"]
    df = df.select("*", *keys, *flags)
    totals = df.groupBy(*on, share).agg(F.sum(amount).alias("total"))
    earlier = (Window.partitionBy(*on).orderBy(share)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*on, share,
                            F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("earlier"))
    within = (Window.partitionBy(*on, share).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.withColumn("inner", F.sum(amount).over(within)).join(offsets, [*on, share])
            .withColumn(name, F.col("earlier") + F.col("inner"))
            .drop(*on, "earlier", "inner"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES,
        seed: int = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), copies and taken (words
    the mix takes, repeats counted), finish (virtual finish time of the first copy)."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                      F.col("source").cast("string").alias("source"),
                                      word_count(F.col("text")).alias("size")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = scratch.write(targets(per_source, weights, most), "targets")
    shares = _shares(sized.count())
    budget = goals.agg(F.sum("source_size").alias("n")).first().n or 0

    # Shuffled order of a source's documents: by a hash of the id, ties by what is left of the row.
    spread = F.xxhash64("doc_id", "source", F.lit(seed))
    queue = (sized.where("size > 0").withColumn("h", spread)
             .withColumn("share", F.shiftrightunsigned("h", 1) % F.lit(shares)))
    queue = _running(queue, ["source"], "share", ["h", "doc_id", "size"], "size", "upto")
    named = goals.withColumnRenamed("source", "s")
    queue = scratch.write(
        queue.join(F.broadcast(named) if goals.limit(10_001).count() <= 10_000 else named,
                   F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "size", "source_size", "target", "upto"), "queue")

    # Copies in virtual time, cut where the budget ends.
    copy = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    finish = (F.col("copy") * F.col("source_size") + F.col("upto")) / F.col("target")
    copies = (queue.where("target > 0").withColumn("copy", copy).withColumn("finish", finish)
              .where("finish <= 2")
              .withColumn("share", F.floor(F.col("finish") * F.lit(shares))))
    served = _running(copies.select("doc_id", "source", "size", "upto", "copy", "finish", "share"),
                      [], "share", ["finish", "source", "upto"], "size", "served")
    taken = (served.where(F.col("served") <= budget)
             .groupBy("source", "upto").agg(F.count("*").alias("copies"), F.min("finish").alias("finish"))
             .select(F.col("source").alias("s"), F.col("upto").alias("u"), "copies", "finish"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("upto") == F.col("u"))
    mixed = queue.join(taken, same, "left").drop("s", "u")
    empty = (sized.where("size = 0")
             .join(F.broadcast(named) if goals.limit(10_001).count() <= 10_000 else named,
                   F.col("source").eqNullSafe(F.col("s")))
             .select("doc_id", "source", "size", "source_size", "target", F.lit(0).alias("upto"),
                     F.lit(0).alias("copies"), F.lit(None).cast("double").alias("finish")))
    return (mixed.unionByName(empty).withColumn("copies", F.coalesce("copies", F.lit(0)).cast("int"))
            .withColumn("taken", F.col("copies") * F.col("size")).drop("upto"))


def serving_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """What the mix takes, in order of virtual finish time."""
    return (mixed.where("copies > 0").repartitionByRange(partitions, "finish", "source", "doc_id")
            .sortWithinPartitions("finish", "source", "doc_id"))

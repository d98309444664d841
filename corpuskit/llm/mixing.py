"""Drawing a mixture of sources with target shares by weighted fair queueing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.operators.ranking import global_running_sum, hash_running_sum
from corpuskit.session import materialize


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int
    available: int = 0

    @property
    def most(self) -> int:
        return self.available * self.max_repeats


def fair_finish(targets: list[Target], budget: int) -> float:
    """Virtual time at which all queues together have served the budget, each no more than it has."""
    left, weights = budget, sum(t.share for t in targets)
    for t in sorted(targets, key=lambda t: t.most / t.share):
        time = left / weights
        if t.most / t.share >= time:
            return time
        left, weights = left - t.most, weights - t.share
        if weights <= 1e-12:
            break
    return max(t.most / t.share for t in targets)


def weighted_mix(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixture, and the report on its sources.

    ``targets`` has ``source, target_share, max_repeats``; it is the stated mixture, a few rows.
    The budget is the summed size of all documents whose source is in it. Mixture:
    ``key, source, copy, size, finish, running``, in no order; ``running`` is the size up to
    and with the row in the order of ``finish``. Report, one row for each target: ``source,
    target_share, max_repeats, available, used, actual_share, is_short``. Shortness is read off
    the queue: a source is short if the last row of its last copy finishes before the virtual
    time at which a queue that never runs dry has served its share of the budget.

    Each source queues its documents in the order of a hash, copy after copy; a document
    finishes at the source's summed size so far divided by the target share. All queues
    are range-sorted by that time and cut where the running size passes the budget. Queues
    that run dry leave their part to the others in proportion to their shares.

    Both orders are taken in parts, so a source with any share of all rows is no bottleneck.
    Documents of other or no source are out, null sizes count as 0. Repeated targets count
    once, with their greatest values; a target without a positive share or without repeats
    draws nothing.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    wanted_rows = wanted.collect()
    spark = docs.sparkSession
    names = spark.createDataFrame([(r["source"],) for r in wanted_rows], "_source string")
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    sized = materialize(sized.join(F.broadcast(names), F.col("source") == F.col("_source"), "left_semi"))
    stats = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("size").alias("n"), F.max("size").alias("m")).collect()}
    budget = sum(r["n"] for r in stats.values())
    known = [Target(r["source"], r["target_share"], r["max_repeats"], stats[r["source"]]["n"] if r["source"] in stats else 0) for r in wanted_rows]
    active = [t for t in known if t.share > 0 and t.most > 0]
    # no row that is kept finishes later than this: one document more than the fair time for each
    # source; every source that can reach its share has a row that finishes at the budget or later
    last = max(fair_finish(active, budget), float(budget)) if active else 0.0
    slack = max((stats[t.source]["m"] / t.share for t in active), default=0.0) * (len(active) + 1)
    copies = [(t.source, t.share, t.available, min(t.max_repeats, int((last + slack) * t.share / t.available) + 1)) for t in active]
    plan = F.broadcast(spark.createDataFrame(copies, "_source string, _w double, _n bigint, _copies int"))
    queued = sized.join(plan, F.col("source") == F.col("_source")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    queued = hash_running_sum(queued.drop("_source", "_copies"), ["source", "copy"], ["copy", "key"], "size", seed, out="_cum")
    timed = queued.withColumn("finish", (F.col("copy") * F.col("_n") + F.col("_cum")) / F.col("_w")).where(F.col("finish") <= F.lit(last + slack))
    served = global_running_sum(timed.select("key", "source", "copy", "size", "finish"), ["finish", "source", "copy", "key"], "size")
    mixture = served.where(F.col("running") <= budget)
    facts = [(t.source, t.share, t.max_repeats, t.available) for t in known]
    ends = served.groupBy("source").agg(F.max("finish").alias("_end"), F.sum(F.when(F.col("running") <= budget, F.col("size"))).alias("used"))
    report = spark.createDataFrame(facts, "source string, target_share double, max_repeats int, available bigint").join(F.broadcast(ends), "source", "left")
    used_or_0 = F.coalesce("used", F.lit(0))
    everything = Window.partitionBy(F.lit(0))  # over the report's few rows
    is_short = (F.col("target_share") > 0) & (F.coalesce("_end", F.lit(0.0)) < budget)
    report = report.select("source", "target_share", "max_repeats", "available", used_or_0.alias("used"), (used_or_0 / F.nullif(F.sum(used_or_0).over(everything), F.lit(0))).alias("actual_share"), is_short.alias("is_short"))
    return mixture.withColumnRenamed("key", key), report

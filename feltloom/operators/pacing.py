"""Request pacing: spacing per domain in closed form, throttle backoff as a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltloom.model import DEFAULT_INTERVAL_S, INITIAL_BACKOFF_S, MAX_BACKOFF_S


def spaced(requests: DataFrame, domain: str, order: list[str], arrival: Column, spacing: int) -> DataFrame:
    """start = max(arrival, previous start + spacing): n * spacing + the running maximum of arrival - n * spacing."""
    by = Window.partitionBy(domain).orderBy(*order)
    numbered = requests.withColumn("n", F.row_number().over(by))
    lead = F.max(arrival - F.col("n") * spacing).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("start", F.col("n") * spacing + lead).drop("n")


def next_backoff(previous: Column, initial: int = INITIAL_BACKOFF_S, most: int = MAX_BACKOFF_S) -> Column:
    return F.when(previous <= 0, F.lit(initial)).otherwise(F.least(previous * 2, F.lit(most)))


def backoffs(outcomes: Column, initial: int = INITIAL_BACKOFF_S, most: int = MAX_BACKOFF_S) -> Column:
    """Backoff after each of an ordered array of outcomes (struct kind, retry_after): a throttle doubles it or
    takes Retry-After, a success clears it, a failure keeps it. Long at most the history of one domain."""
    start = F.array().cast("array<bigint>")

    def step(done: Column, o: Column) -> Column:
        last = F.coalesce(F.element_at(F.reverse(F.concat(F.array(F.lit(0).cast("bigint")), done)), 1), F.lit(0))
        new = F.when(o["kind"] == "throttle", F.when(F.coalesce(o["retry_after"], F.lit(0)) > 0, o["retry_after"]).otherwise(next_backoff(last, initial, most))).when(o["kind"] == "ok", F.lit(0)).otherwise(last)
        return F.concat(done, F.array(new.cast("bigint")))

    return F.aggregate(outcomes, start, step)


def doubling_backoff(rows: DataFrame, domain: str, order: list[str], kind: Column, initial: int = INITIAL_BACKOFF_S, most: int = MAX_BACKOFF_S) -> DataFrame:
    """The same without Retry-After, in closed form: throttles since the last success, counted."""
    upto = Window.partitionBy(domain).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = rows.withColumn("run", F.sum((kind == "ok").cast("int")).over(upto))
    within = Window.partitionBy(domain, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = F.sum((kind == "throttle").cast("int")).over(within)
    cap = (most // initial).bit_length()
    doubled = F.lit(initial) * F.pow(F.lit(2.0), F.least(F.col("hits"), F.lit(cap + 1)) - 1)
    return runs.withColumn("hits", hits).withColumn("backoff", F.when(F.col("hits") == 0, F.lit(0)).otherwise(F.least(doubled, F.lit(most))).cast("bigint")).drop("run", "hits")


def interval_groups(sources: DataFrame, interval: Column, default: int = DEFAULT_INTERVAL_S) -> DataFrame:
    """Sources by their effective interval: members, and the place of each group by its first member."""
    each = sources.withColumn("every", F.coalesce(F.nullif(interval, F.lit(0)), F.lit(default)).cast("bigint"))
    return each.groupBy("every").agg(F.count("*").alias("n"), F.min("ord").alias("first"))

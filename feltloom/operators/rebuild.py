"""Stored rows derived anew from their saved input when an extractor's version changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_legacy(metadata: Column) -> Column:
    """A row stored before inputs were saved."""
    return (F.coalesce(metadata, F.lit("")) == "") | F.coalesce(F.get_json_object(metadata, "$.legacy") == "true", F.lit(False))


def rebuild(stored: DataFrame, schema: str, derive, columns: list[str], metadata: str = "metadata") -> DataFrame:
    """``stored`` with ``columns`` derived again from the saved JSON by ``derive(struct) -> {name: Column}``.

    A row whose input is missing or malformed is kept as it is (``rebuilt`` false); one whose identity or
    date would change fails the job.
    """
    parsed = stored.withColumn("input", F.from_json(F.col(metadata), schema))
    made = derive(F.col("input"))
    ok = F.coalesce(F.col("input").isNotNull() & ~is_legacy(F.col(metadata)), F.lit(False))
    for name in columns:
        ok &= made[name].isNotNull()
    flagged = parsed.withColumn("rebuilt", ok)
    for name in ("guid", "pub_date"):
        if name in made:
            moved = F.col("rebuilt") & ~made[name].eqNullSafe(F.col(name))
            flagged = flagged.withColumn("rebuilt", F.when(moved, F.raise_error(F.lit(f"a rebuilt row changes its {name}"))).otherwise(F.col("rebuilt")))
    return flagged.select(*[F.when(F.col("rebuilt"), made[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns], "rebuilt")


def needs_rebuild(state: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources whose stored version is not the running one: they are also fetched unconditionally."""
    return sources.join(state.select(F.col("source_id").alias("id"), F.col("extract_version").alias("stored")), "id", "left").where(~F.col("stored").eqNullSafe(F.col("extract_version")))

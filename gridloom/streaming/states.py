"""A stream of equipment states (ts, ibus, jbus, ckt, stat) enriched with the static model, and outages counted in windows.

The model has no streams of its own; this is what its enrichment and tie-line queries become on one. The static side is joined as a
table, so each micro-batch is an ordinary equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_areas(states: DataFrame, bus: DataFrame) -> DataFrame:
    """The states with both ends' area and kV."""
    for c in ("ibus", "jbus"):
        side = bus.select(F.col("ibus").alias(f"_{c}"), F.col("area").alias(f"{c}_area"), F.col("baskv").alias(f"{c}_baskv"))
        states = states.join(side, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    return states


def tie_line_states(states: DataFrame, bus: DataFrame, native_areas) -> DataFrame:
    rows = with_areas(states, bus)
    native = [F.coalesce(F.col(f"{c}_area").isin(list(native_areas)), F.lit(False)) for c in ("ibus", "jbus")]
    return rows.where(native[0] != native[1])


def outages(states: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window, lines out of service in it; late rows count until the watermark has passed."""
    out = states.where("stat = 0").withWatermark("ts", late)
    return out.groupBy(F.window("ts", window)).agg(F.approx_count_distinct(F.struct("ibus", "jbus", "ckt")).alias("lines_out"))

"""Column expressions and frame helpers; all built in, none in Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def format_kv(kv: Column) -> Column:
    """500.0 -> 500kV, 34.5 -> 34.5kV, null -> empty."""
    text = F.regexp_replace(F.format_string("%.6f", kv.cast("double")), r"\.?0+$", "")
    return F.when(kv.isNull() | F.isnan(kv.cast("double")), "").otherwise(F.concat(text, F.lit("kV")))


def join_parts(parts: list[Column], by: str = " - ") -> Column:
    return F.concat_ws(by, *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def derived_name(ends: list[tuple[Column, Column]], ident: Column, circuit: bool) -> Column:
    """`name kV - name kV CKT id`; with one bus `name kV - id`. Ends that have no bus are left out."""
    buses = [F.when(name.isNotNull(), F.concat(F.trim(name), F.lit(" "), format_kv(kv))) for name, kv in ends]
    label = F.trim(ident.cast("string"))
    if len(ends) == 1:
        return join_parts([*buses, label])
    return F.trim(F.concat_ws(" ", join_parts(buses), F.concat(F.lit("CKT "), label) if circuit else label))


def coalesce_columns(df: DataFrame, new: str, first: str, second: str, drop: bool = False) -> DataFrame:
    out = df.withColumn(new, F.coalesce(first, second))
    return out.drop(*[c for c in (first, second) if c != new]) if drop else out


def move_left(df: DataFrame, columns: list[str]) -> DataFrame:
    own = [c for c in columns if c in df.columns]
    return df.select(*own, *[c for c in df.columns if c not in own])


def move_right(df: DataFrame, columns: list[str]) -> DataFrame:
    own = [c for c in columns if c in df.columns]
    return df.select(*[c for c in df.columns if c not in own], *own)


def multi_replace(text: Column, pairs: dict[str, str]) -> Column:
    """One replacement after the other, in the order given."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), text)


def naive(ts: Column, zone: str = "UTC") -> Column:
    """An instant as the wall-clock time of a zone, without zone."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz"))


def naive_frame(df: DataFrame, zone: str = "UTC") -> DataFrame:
    return df.withColumns({f.name: naive(F.col(f.name), zone) for f in df.schema if f.dataType.simpleString() == "timestamp"})


def clean_json(text: Column) -> Column:
    """Control characters (but tabs and line ends, which may stand between values) are escaped, `12.` becomes `12.0`."""
    codes = [k for k in (*range(32), 127) if k not in (9, 10, 13)]
    escaped = reduce(lambda c, k: F.replace(c, F.lit(chr(k)), F.lit(f"\\u{k:04x}")), codes, text)
    return F.regexp_replace(escaped, r"(\d)\.(?=\s*[,\]}])", "$1.0")


# Lower bounds in kV of the colour buckets.
_KV_COLOURS = [(765, "765+"), (500, "500"), (230, "230"), (115, "115"), (69, "69"), (0, "low")]


def kv_bucket(kv: Column) -> Column:
    out = F.lit("unknown")
    for low, name in reversed(_KV_COLOURS):
        out = F.when(kv >= low, name).otherwise(out)
    return out


#: Tried in this order; the first that takes every value that is there is the column's type.
LADDER = ("timestamp", "bigint", "double", "string")


def coerce(df: DataFrame, ladder: tuple[str, ...] = LADDER, columns: list[str] | None = None) -> DataFrame:
    """String columns get the first type of the ladder that loses nothing. One pass over the data, whatever the number of columns."""
    own = [c for c in (columns or df.columns) if isinstance(df.schema[c].dataType, StringType)]
    if not own:
        return df

    def fits(c: str, t: str) -> Column:
        v = F.trim(c)
        if t == "bigint":
            ok = v.try_cast("double") == F.round(v.try_cast("double"))
        elif t == "timestamp":
            ok = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), v.try_cast("timestamp")).isNotNull()
        else:
            ok = v.try_cast(t).isNotNull()
        return F.bool_and(F.when(F.col(c).isNotNull(), F.coalesce(ok, F.lit(False)))).alias(f"{c}|{t}")

    found = df.agg(*[fits(c, t) for c in own for t in ladder]).first()
    chosen = {c: next((t for t in ladder if found[f"{c}|{t}"]), "string") for c in own}
    cast = {c: F.trim(c).cast("double").cast(t) if t == "bigint" else F.trim(c).cast(t) for c, t in chosen.items() if t != "string"}
    return df.withColumns(cast) if cast else df


def auto_scalar(text: Column) -> Column:
    """A scalar's text as a number where it is one: double, else the text stays."""
    return F.coalesce(F.trim(text).try_cast("double").cast("string"), text)


def validate_column(df: DataFrame, column: str, nullable: bool = True, dtype: str | None = None, low=None, high=None, isin: list | None = None, pattern: str | None = None, criteria: str = "all") -> str:
    """What is wrong with a column, as text; empty if nothing is. All checks are one aggregate."""
    c, wrong = F.col(column), []
    checks = {"nulls": F.count_if(c.isNull()), "low": F.min(c) if low is not None else F.lit(None), "high": F.max(c) if high is not None else F.lit(None)}
    checks["outside"] = F.count_if(c.isNotNull() & ~c.isin(isin)) if isin is not None else F.lit(0)
    checks["match"] = (F.bool_and if criteria == "all" else F.bool_or)(F.when(c.isNotNull(), c.cast("string").rlike(pattern))) if pattern else F.lit(True)
    r = df.agg(*[v.alias(k) for k, v in checks.items()]).first()
    if not nullable and r["nulls"]:
        wrong.append(f"{column} has {r['nulls']} nulls")
    if dtype and df.schema[column].dataType.simpleString() != dtype:
        wrong.append(f"{column} is {df.schema[column].dataType.simpleString()}, not {dtype}")
    if low is not None and r["low"] is not None and r["low"] < low:
        wrong.append(f"{column} has {r['low']}, under {low}")
    if high is not None and r["high"] is not None and r["high"] > high:
        wrong.append(f"{column} has {r['high']}, over {high}")
    if r["outside"]:
        wrong.append(f"{column} has {r['outside']} values that are not among those allowed")
    if r["match"] is False:
        wrong.append(f"{column} does not match {pattern}")
    return "; ".join(wrong)


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)

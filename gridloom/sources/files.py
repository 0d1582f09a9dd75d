"""Contingency files, ragged tables, listings."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.operators.contingency import numbered_blocks


def read_contingencies(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, position, text: each definition of each file."""
    files = spark.read.text(paths, wholetext=True)
    return numbered_blocks(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def newest(spark: SparkSession, path: str, pattern: str = "*.raw") -> str | None:
    """The file that was changed last."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    row = rows.select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path").first()
    return row["path"] if row else None


def model_files(folder: str) -> list[str]:
    """RAWX files by name, then RAW files by name."""
    if not Path(folder).is_dir():
        raise FileNotFoundError(folder)
    return [str(p) for s in ("*.rawx", "*.raw") for p in sorted(Path(folder).glob(s))]


def read_ragged(spark: SparkSession, path: str, header: list[str] | None = None, separator: str = ",", header_rows: int = 0) -> DataFrame:
    """A table whose rows differ in length: short rows are padded, columns beyond the header are called Col<n>. Values may stand in double
    quotes, which may hold the separator and doubled quotes. header_rows: that many lines at the top of each file are titles; without
    a header given, the first file's (by name) are joined column by column with a blank."""
    lines = spark.read.text(path, wholetext=bool(header_rows))
    if header_rows:
        lines = lines.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
        if header is None:
            top = lines.where(F.col("at") < header_rows).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v")).orderBy("file").first()
            titles = [[c.strip().strip('"') for c in r["value"].split(separator)] for r in (top["v"] if top else [])]
            header = [" ".join(t[k] for t in titles if k < len(t) and t[k]) for k in range(max(map(len, titles), default=0))]
        lines = lines.where((F.col("at") >= header_rows) & (F.col("value") != "")).select("value")
    mark = re.escape(separator)
    field = F.regexp_extract_all(F.concat(F.lit(separator), "value"), F.lit(rf'{mark}\s*("(?:[^"]|"")*"|[^{mark}]*)'), F.lit(1))
    plain = F.transform(field, lambda x: F.when(F.trim(x).startswith('"'), F.replace(F.regexp_replace(F.trim(x), r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.trim(x)))
    rows = lines.select(plain.alias("v"))
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    names = [(header or [])[k] if k < len(header or []) else f"Col{k}" for k in range(width)]
    return rows.select(*[F.try_element_at("v", F.lit(k + 1)).alias(n) for k, n in enumerate(names)])


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)

"""Where results go: CSV folders by Spark's writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.compare import path_text, reorder
from gridloom.operators.network import Network


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text, since CSV has none."""
    return df.select(*[(F.array_join(F.col(f.name).cast("array<string>"), ", ") if f.dataType.typeName() == "array" else F.col(f.name)).alias(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    _flat(df).write.mode("overwrite").option("header", True).csv(path)


def network_csv(network: Network, folder: str) -> None:
    """general and network_<section>."""
    spark = network["bus"].sparkSession
    write_csv(spark.createDataFrame([(k, str(v)) for k, v in network.general.items()], "key string, value string"), f"{folder}/general")
    for name, df in network.sections.items():
        write_csv(df, f"{folder}/network_{name}")


def comparison_csv(tables: dict, graph: dict, folder: str, info: dict | None = None) -> None:
    """info, network_<section> (no substations, no generic elements), graph_<key>."""
    spark = next(df for df in tables.values() if isinstance(df, DataFrame)).sparkSession
    write_csv(spark.createDataFrame([(k, str(v)) for k, v in (info or {}).items()], "key string, value string"), f"{folder}/info")
    for name, df in tables.items():
        if isinstance(df, DataFrame) and not name.startswith(("sub", "gne")):
            write_csv(df.select(*reorder(df.columns)), f"{folder}/network_{name}")
    for name, df in graph.items():
        write_csv(df.withColumn("path", path_text(F.col("path"))) if "path" in df.columns else df, f"{folder}/graph_{name}")


def area_con(rows: DataFrame, folder: str) -> None:
    """Contingency definitions, a folder for each area."""
    rows.select("area_name", F.col("text").alias("value")).write.mode("overwrite").partitionBy("area_name").text(folder)

"""Two models compared: table by table, and edge by edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gridloom.config import COMPARISON_QUERIES, KV_BAND, MAX_PATH_EDGES
from gridloom.functions.predicates import to_column
from gridloom.operators import topology
from gridloom.operators.network import Network
from gridloom.registry import section


def bus_num_changes(bus1: DataFrame, bus2: DataFrame, on: list[str] = ("name", "area", "baskv")) -> DataFrame:
    """Buses with equal attributes (null equals null) and other numbers."""
    on = list(on)
    assert "ibus" not in on, "the number itself cannot be joined on"
    missing = [c for c in on if c not in bus1.columns or c not in bus2.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    a = bus1.select(F.col("ibus").alias("ibus_model1"), *on)
    b = bus2.select(F.col("ibus").alias("ibus_model2"), *[F.col(c).alias(f"_{c}") for c in on])
    cond = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    return a.join(b, cond).where("ibus_model1 <> ibus_model2").select("ibus_model1", "ibus_model2", *on)


def diff_section(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, then <c>_model1, <c>_model2, <c>_delta for columns of both, the others as they are, and presence. Numeric deltas are
    differences; other deltas tell whether the values differ, null equal to null. Presence is told by markers, not by any column."""
    common = [c for c in a.columns if c in b.columns and c not in keys]
    left = a.select(*keys, *[F.col(c).alias(f"{c}_model1" if c in common else c) for c in a.columns if c not in keys], F.lit(True).alias("_one"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_model2" if c in common else c) for c in b.columns if c not in keys], F.lit(True).alias("_two"))
    both = left.join(right, keys, "full_outer")

    def delta(c: str) -> Column:
        x, y = F.col(f"{c}_model1"), F.col(f"{c}_model2")
        numeric = all(isinstance(d.schema[c].dataType, NumericType) for d in (a, b))
        return (y - x if numeric else ~x.eqNullSafe(y)).alias(f"{c}_delta")

    presence = F.when(F.col("_one") & F.col("_two"), "both").when(F.col("_one"), "model1_only").otherwise("model2_only")
    cols = [x for c in a.columns if c not in keys for x in ([F.col(f"{c}_model1"), F.col(f"{c}_model2"), delta(c)] if c in common else [F.col(c)])]
    return both.select(*keys, *cols, *[F.col(c) for c in b.columns if c not in keys and c not in common], presence.alias("presence"))


def diff_by_position(a: DataFrame, b: DataFrame) -> DataFrame:
    """diff_section by `position` of the rows, for sections without key columns. A table has no order of its own, so positions are those
    of the rows sorted by all columns. Such sections hold a case's settings, a few rows each, so one task may sort them."""

    def numbered(df: DataFrame) -> DataFrame:
        order = Window.orderBy(*[F.col(c).asc_nulls_first() for c in sorted(df.columns)])
        return df.withColumn("position", F.row_number().over(order) - 1)

    return diff_section(numbered(a), numbered(b), ["position"])


def unpivoted(diff: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A row for each key and field whose values differ: keys, field, model1, model2, delta. The fields must have types alike."""
    one = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_model1").alias("model1"), F.col(f"{f}_model2").alias("model2"), F.col(f"{f}_delta").alias("delta")) for f in fields])
    return diff.select(*keys, F.explode(one).alias("_x")).where(~F.col("_x.model1").eqNullSafe(F.col("_x.model2"))).select(*keys, "_x.*")


class Comparison:
    def __init__(self, one: Network, two: Network):
        self.one, self.two = one, two

    def renumbered(self, on: list[str] = ("name", "area", "baskv")) -> DataFrame:
        return bus_num_changes(self.one["bus"], self.two["bus"], on)

    def tables(self, enrich: bool = True) -> dict[str, DataFrame]:
        """A diff for each section of both models; sections of one model only under removed_equip_types and added_equip_types."""
        one, two = (n.with_bus_everywhere() if enrich else n for n in (self.one, self.two))
        out: dict = {"removed_equip_types": sorted(set(one.sections) - set(two.sections)), "added_equip_types": sorted(set(two.sections) - set(one.sections))}
        for name in sorted(set(one.sections) & set(two.sections)):
            keys = [k for k in section(name).id_cols if k in one[name].columns and k in two[name].columns]
            out[name] = diff_section(one[name], two[name], keys) if keys else diff_by_position(one[name], two[name])
        out["bus_num_changes"] = self.renumbered()
        return out

    def graph(self, mode: str = "triangle", most: int = MAX_PATH_EDGES) -> dict[str, DataFrame]:
        """removed and added nodes and edges; path_sectionalizations: how model 2 replaces removed edges by paths through new nodes;
        path_bypasses: the same the other way round."""
        e1, e2 = (topology.canonical(n.edges(mode).select(F.col("src").alias("x"), F.col("dst").alias("y"))) for n in (self.one, self.two))
        n1, n2 = (e.select(F.explode(F.array("a", "b")).alias("node")).union(n["bus"].select(topology.bus_node("ibus"))).distinct() for n, e in ((self.one, e1), (self.two, e2)))
        removed, added = edge_changes(e1, e2)
        labels = bus_labels([n["bus"] for n in (self.one, self.two)])
        return {
            "removed_nodes": n1.join(n2, "node", "left_anti"),
            "added_nodes": n2.join(n1, "node", "left_anti"),
            "removed_edges": removed,
            "added_edges": added,
            "path_sectionalizations": named_paths(alternate_paths(removed, e2, n1, n2, most), labels),
            "path_bypasses": named_paths(alternate_paths(added, e1, n2, n1, most), labels),
        }

    def kv_buses(self, low: float = KV_BAND[0], high: float = KV_BAND[1]) -> DataFrame:
        """Buses that carry a generator or load in either model, within the band in either."""
        used = [n[s].select("ibus") for n in (self.one, self.two) for s in ("generator", "load") if s in n]
        return kv_buses(diff_section(self.one["bus"], self.two["bus"], ["ibus"]), used, low, high)

    def query(self, queries: dict[str, str | Column] = COMPARISON_QUERIES, low: float = KV_BAND[0], high: float = KV_BAND[1]) -> dict[str, DataFrame]:
        """The diffs narrowed to the buses of kv_buses, by key columns, and to each section's own filter."""
        keep, out = self.kv_buses(low, high).distinct(), {}  # several rows of a bus (numbers used twice) match once
        for name, df in self.tables().items():
            if not isinstance(df, DataFrame):
                continue
            own = [c for c in section(name).bus_cols if c in df.columns]
            if own:
                for k, c in enumerate(own):
                    df = df.join(keep.select(F.col("ibus").alias(f"_b{k}"), F.lit(True).alias(f"_k{k}")), F.col(c) == F.col(f"_b{k}"), "left")
                df = df.where(F.coalesce(*[F.col(f"_k{k}") for k in range(len(own))], F.lit(False))).drop(*[f"_{x}{k}" for k in range(len(own)) for x in "bk"])
            if name in queries:
                q = queries[name]
                df = df.where(to_column(q, df.columns) if isinstance(q, str) else q)
            out[name] = df
        return out


def edge_changes(e1: DataFrame, e2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, added) undirected edges (a, b)."""
    return e1.join(e2, ["a", "b"], "left_anti"), e2.join(e1, ["a", "b"], "left_anti")


def alternate_paths(gone: DataFrame, other: DataFrame, own_nodes: DataFrame, other_nodes: DataFrame, most: int = MAX_PATH_EDGES) -> DataFrame:
    """(a, b, path, edges): for each edge that is gone and whose ends the other graph has, the shortest simple paths there (ties kept)
    that lead through nodes only that the own graph lacks."""
    new = other_nodes.join(own_nodes, "node", "left_anti")
    for c in "ab":
        gone = gone.join(other_nodes.select(F.col("node").alias(c)), c, "left_semi")
    paths = topology.simple_paths(gone.select("a", "b"), other, new, most, shortest=True).withColumn("edges", F.size("path") - 1)
    return paths


def kv_buses(bus_diff: DataFrame, used: list[DataFrame], low: float, high: float) -> DataFrame:
    ids = used[0]
    for u in used[1:]:
        ids = ids.union(u)
    band = F.col("baskv_model1").between(low, high) | F.col("baskv_model2").between(low, high)
    return bus_diff.where(band).select("ibus").join(ids.distinct(), "ibus", "left_semi")


def bus_label(name: Column, ibus: Column, kv: Column, ide: Column) -> Column:
    """NAME (num) [kV kV, ide=n]."""
    return F.concat(F.trim(name), F.lit(" ("), ibus.cast("string"), F.lit(") ["), F.regexp_replace(F.format_string("%.6f", kv.cast("double")), r"\.?0+$", ""), F.lit(" kV, ide="), ide.cast("string"), F.lit("]"))


def bus_labels(tables: list[DataFrame]) -> DataFrame:
    """(node, label): each bus node's label; of buses in several tables the first table's."""
    out = None
    for k, bus in enumerate(tables):
        cols = {c: F.col(c) if c in bus.columns else F.lit(None).cast("string") for c in ("name", "baskv", "ide")}
        detail = F.concat_ws(", ", F.concat(F.regexp_replace(F.format_string("%.6f", cols["baskv"].cast("double")), r"\.?0+$", ""), F.lit(" kV")), F.concat(F.lit("ide="), cols["ide"].cast("string")))
        name = F.coalesce(F.trim(cols["name"]), F.concat(F.lit("BUS "), F.col("ibus").cast("string")))
        label = F.concat(name, F.lit(" ("), F.col("ibus").cast("string"), F.lit(")"), F.when(detail != "", F.concat(F.lit(" ["), detail, F.lit("]"))).otherwise(F.lit("")))
        rows = bus.select(topology.bus_node("ibus").alias("node"), F.lit(k).alias("_k"), label.alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("node").agg(F.min_by("label", F.struct("_k", "label")).alias("label"))


def named_paths(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """The paths with original_path_named (`label - label` of the edge that the path stands for, ends in their order) and path_named
    (labels joined by ` -> `). Nodes without a label keep their own name. Each node is joined once, not each pair of nodes."""
    rows = paths.select("a", "b", "path", F.posexplode("path").alias("_at", "node")).join(labels, "node", "left")
    parts = F.sort_array(F.collect_list(F.struct("_at", F.coalesce("label", F.col("node").cast("string")).alias("label"))))
    named = rows.groupBy("a", "b", "path").agg(F.transform(parts, lambda x: x["label"]).alias("_labels"))
    ends = F.concat_ws(" - ", F.element_at("_labels", 1), F.element_at("_labels", -1))
    return paths.join(named, ["a", "b", "path"]).withColumns({"original_path_named": ends, "path_named": F.array_join("_labels", " -> ")}).drop("_labels")


def path_text(path: Column) -> Column:
    return F.array_join(path.cast("array<string>"), " -> ")


def reorder(columns: list[str]) -> list[str]:
    """<c>_named after <c>; <bus>_{name,baskv,area}_modelN after <bus>_modelN."""
    out = [c for c in columns if not c.endswith("_named")]
    for c in columns:
        if c.endswith("_named") and c.removesuffix("_named") in out:
            out.insert(out.index(c.removesuffix("_named")) + 1, c)
        elif c.endswith("_named"):
            out.append(c)
    for n in ("model1", "model2"):
        for bus in [c.removesuffix(f"_{n}") for c in columns if c.endswith(f"bus_{n}")]:
            at = out.index(f"{bus}_{n}") + 1
            own = [f"{bus}_{f}_{n}" for f in ("name", "baskv", "area") if f"{bus}_{f}_{n}" in out]
            for c in reversed(own):
                where = out.index(c)
                out.insert(at, c)
                del out[where + (where >= at)]
    return out

"""One model's sections as DataFrames, and the queries on them. Nothing is changed in place: each operator gives a new Network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.predicates import to_column
from gridloom.functions.scalar import derived_name
from gridloom.operators import topology
from gridloom.registry import REGISTRY, Section, section

GRAPH_EFFECTS = ("clear", "regenerate", "leave")


class Network:
    """sections: name -> DataFrame. `original_bus` is the bus table before any filter; enrichment joins with it."""

    def __init__(self, sections: dict[str, DataFrame], original_bus: DataFrame | None = None, general: dict | None = None):
        self.sections = dict(sections)
        self.original_bus = original_bus if original_bus is not None else sections.get("bus")
        self.general = general or {}

    def __getitem__(self, name: str) -> DataFrame:
        return self.sections[name]

    def __contains__(self, name: str) -> bool:
        return name in self.sections

    def schema_of(self, name: str) -> Section:
        return section(name)

    def get(self, name: str, spark: SparkSession | None = None) -> DataFrame:
        """The section; one that the model lacks is an empty table of the declared schema."""
        if name in self.sections:
            return self.sections[name]
        return (spark or self.sections["bus"].sparkSession).createDataFrame([], REGISTRY[name].schema)

    def _with(self, changed: dict[str, DataFrame]) -> Network:
        return Network(self.sections | changed, self.original_bus, self.general)

    def bus_columns(self, name: str) -> list[str]:
        """The section's bus columns that its table has."""
        return [c for c in section(name).bus_cols if c in self.sections[name].columns]

    # Enrichment

    def with_bus(self, name: str, where: str | Column | None = None, fields: list[str] | None = None) -> DataFrame:
        """The section with the bus table's columns for each bus column ({bus column}_{field}), area names and derived_name."""
        own, rows = self.bus_columns(name), self.sections[name]
        if not own:
            raise ValueError(f"{name} has no bus columns")
        if where is not None:
            rows = rows.where(to_column(where, rows.columns) if isinstance(where, str) else where)
        bus = self.original_bus.select(*[c for c in self.original_bus.columns if fields is None or c in {*fields, "ibus"}])
        area = self.sections.get("area")
        for c in own:
            side = bus.select(*[F.col(f).alias(f"{c}_{f}" if f != "ibus" else f"_{c}") for f in bus.columns])
            rows = rows.join(side, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
            if area is not None and f"{c}_area" in rows.columns:
                named = area.select(F.col("iarea").alias("_area"), F.col("arname").alias(f"{c}_area_name"))
                rows = rows.join(named, F.col(f"{c}_area") == F.col("_area"), "left").drop("_area")
        ident = [k for k in section(name).id_cols if k not in own and k in rows.columns]
        if ident and all(f"{c}_{f}" in rows.columns for c in own for f in ("name", "baskv")):
            ends = [(F.col(f"{c}_name"), F.col(f"{c}_baskv")) for c in (sorted(own) if name == "vscdc" else own)]
            rows = rows.withColumn("derived_name", derived_name(ends, F.col(ident[0]), ident[0] == "ckt"))
        return rows

    def with_bus_everywhere(self) -> Network:
        return self._with({n: self.with_bus(n) for n in self.sections if n != "bus" and self.bus_columns(n) and self.bus_columns(n) == list(section(n).bus_cols)})

    # Filters

    def any_bus(self, name: str, keep: DataFrame, key: str = "ibus") -> DataFrame:
        """Rows of which any bus is in keep[key]: a hashed lookup for each bus column, no nested loop."""
        rows, own = self.sections[name], self.bus_columns(name)
        if not own:
            return rows
        kept = keep.select(F.col(key).alias("_bus")).distinct()
        for k, c in enumerate(own):
            side = kept.select(F.col("_bus").alias(f"_bus{k}"), F.lit(True).alias(f"_in{k}"))
            rows = rows.join(side, F.col(c) == F.col(f"_bus{k}"), "left")
        hit = F.coalesce(*[F.col(f"_in{k}") for k in range(len(own))], F.lit(False))
        return rows.where(hit).drop(*[f"_{x}{k}" for k in range(len(own)) for x in ("bus", "in")])

    def restricted(self, keep: DataFrame) -> Network:
        """The network of these buses; equipment stays if any of its buses does."""
        ids = keep.select("ibus").distinct()
        out = {n: self.any_bus(n, ids) for n in self.sections if n != "bus" and self.bus_columns(n)}
        return self._with(out | {"bus": self["bus"].join(ids, "ibus", "left_semi")})

    def filter_by_area(self, areas, graph_effect: str = "clear") -> Network:
        areas = list(areas)
        _check_effect(graph_effect)
        if not areas:
            raise ValueError("no areas given")
        return self.restricted(self["bus"].where(F.col("area").isin(areas)))

    def filter_by_kv(self, low: float = 0, high: float = float("inf"), graph_effect: str = "clear") -> Network:
        """low <= kV < high."""
        _check_effect(graph_effect)
        if low < 0 or high <= low:
            raise ValueError("kV bounds must hold 0 <= low < high")
        return self.restricted(self["bus"].where((F.col("baskv") >= low) & (F.col("baskv") < high)))

    def filter_section(self, name: str, where: str, graph_effect: str = "clear") -> Network:
        _check_effect(graph_effect)
        if name not in self.sections:
            raise ValueError(f"no section {name!r}")
        return self._with({name: self[name].where(to_column(where, self[name].columns))})

    # Graph queries

    def tie_lines(self, native_areas, kv_min: float | None = None, kv_max: float | None = None) -> DataFrame:
        """Lines of which just one end is in a native area; kV bounds hold for both ends. A missing bus is not native."""
        rows = self.with_bus("acline")
        native = [F.coalesce(F.col(f"{c}_area").isin(list(native_areas)), F.lit(False)) for c in ("ibus", "jbus")]
        rows = rows.where(native[0] != native[1])
        for c in ("ibus_baskv", "jbus_baskv"):
            if kv_min is not None:
                rows = rows.where(F.col(c) >= kv_min)
            if kv_max is not None:
                rows = rows.where(F.col(c) <= kv_max)
        return rows

    def hop_edges(self) -> DataFrame:
        return topology.hop_edges(self)

    def within_hops(self, seeds: DataFrame, n: int) -> DataFrame:
        """(ibus, hop) of the buses that the seeds reach in n hops; seeds that the model lacks are left out."""
        nodes = self["bus"].select(F.col("ibus").alias("node")).distinct()
        found = topology.hops(self.hop_edges(), seeds.select(F.col("ibus").alias("node")), n, nodes=nodes)
        return found.select(F.col("node").alias("ibus"), "hop")

    def neighborhood(self, seeds: DataFrame, n: int, output: str = "network"):
        near = self.within_hops(seeds, n)
        return _shape(self.restricted(near), output)

    def tie_line_neighborhood(self, n: int, native_areas, side: str = "both", kv_min=None, kv_max=None, output: str = "network"):
        """What lies within n hops of the tie lines' ends; of that the internal part, the external or both."""
        ties = self.tie_lines(native_areas, kv_min, kv_max)
        seeds = ties.select("ibus").union(ties.select(F.col("jbus").alias("ibus"))).distinct()
        near = self.restricted(self.within_hops(seeds, n))
        native = F.coalesce(F.col("area").isin(list(native_areas)), F.lit(False))
        if side in ("internal", "external"):
            near = near.restricted(near["bus"].where(native if side == "internal" else ~native & F.col("area").isNotNull()))
        return _shape(near, output)

    def nodes(self) -> DataFrame:
        return topology.nodes(self)

    def edges(self, mode: str = "triangle") -> DataFrame:
        return topology.edges(self, mode)

    def flat(self) -> DataFrame:
        """All sections in one table, with a leading section column; columns of unlike types become strings."""
        kinds: dict[str, set] = {}
        for df in self.sections.values():
            for f in df.schema:
                kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
        out = None
        for name, df in self.sections.items():
            own = df.select(F.lit(name).alias("section"), *[(F.col(c).cast("string") if len(kinds[c]) > 1 else F.col(c)).alias("_section" if c == "section" else c) for c in df.columns])
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out


def _check_effect(effect: str) -> None:
    """The graph is derived when asked for, so no effect needs work; unknown ones are refused."""
    if effect not in GRAPH_EFFECTS:
        raise ValueError(f"graph_effect must be one of {GRAPH_EFFECTS}")


def _shape(network: Network, output: str):
    if output == "network":
        return network
    if output == "dict":
        return dict(network.sections)
    if output == "dataframe":
        return network.flat()
    raise ValueError("output must be network, dict or dataframe")

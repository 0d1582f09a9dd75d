"""Contingency definitions: references to equipment, validation, voltage filter, duplicates, fan-out by area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.config import CONTINGENCY_KEEP, CONTINGENCY_KV
from gridloom.storage import stored

_PARTS = {"<number>": r"(\d+)", "<id>": r"""['"]?\s*([^\s'"]+)\s*['"]?""", "<circuit>": "C(?:KT|IRCUIT)"}


def command(text: str) -> str:
    """The pattern of a piece of a command: words in either case between blanks, numbers, and ids, bare or in quotes."""
    return r"(?i)(?<!\w)" + r"\s+".join(_PARTS.get(part, part) for part in text.split())


#: What a definition may name: kind -> (how it is named, which of the captured parts make its reference, in order).
NAMED = {
    "bus": (command("BUS <number>"), (1,)),
    "branch": (command("FROM BUS <number> TO BUS <number> <circuit> <id>"), (1, 2, 3)),
    "transformer": (command("BUS <number> TO BUS <number> TO BUS <number> <circuit> <id>"), (1, 2, 3, 4)),
    "generator": (command("MACHINE <id> FROM BUS <number>"), (2, 1)),
    "load": (command("LOAD <id> FROM BUS <number>"), (2, 1)),
}
#: A definition goes from the line that opens it to the line that ends it; a comment line may call it repeated.
DEFINITION = r"(?ims)^[ \t]*CONTINGENCY\b.*?^[ \t]*END\b"
SAID_REPEATED = r"(?im)^[ \t]*//[^\n]*\bREPEATED\b"


def references(cons: DataFrame, text: str = "text", key: str = "con_id") -> DataFrame:
    """(key, kind, ref): what each definition names, once each; ref is the numbers and the circuit or machine, joined by /."""

    def all_of(pattern: str, groups: tuple[int, ...]):
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
        return F.arrays_zip(*[p.alias(f"g{k}") for k, p in enumerate(parts)]) if len(parts) > 1 else F.transform(parts[0], lambda x: F.struct(x.alias("g0")))

    out = None
    for kind, (pattern, groups) in NAMED.items():
        rows = cons.select(key, F.explode(all_of(pattern, groups)).alias("m"))
        ref = F.concat_ws("/", *[F.trim(F.col(f"m.g{k}")) for k in range(len(groups))])
        rows = rows.select(key, F.lit(kind).alias("kind"), ref.alias("ref"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def known_references(bus: DataFrame, acline: DataFrame, transformer: DataFrame | None, generator: DataFrame, load: DataFrame) -> DataFrame:
    """(kind, ref) of all that a model has; branches in both directions, transformers in every order of their buses."""
    s = lambda c: F.trim(F.col(c).cast("string"))
    ref = lambda *c: F.concat_ws("/", *[s(x) for x in c])
    parts = [("bus", bus, ["ibus"]), ("branch", acline, ["ibus", "jbus", "ckt"]), ("branch", acline, ["jbus", "ibus", "ckt"]), ("generator", generator, ["ibus", "machid"]), ("load", load, ["ibus", "loadid"])]
    if transformer is not None:
        two = transformer.where(F.coalesce("kbus", F.lit(0)) == 0)
        three = transformer.where(F.coalesce("kbus", F.lit(0)) != 0)
        parts += [("branch", two, ["ibus", "jbus", "ckt"]), ("branch", two, ["jbus", "ibus", "ckt"])]
        parts += [("transformer", three, [f"{a}bus", f"{b}bus", f"{c}bus", "ckt"]) for a in "ijk" for b in "ijk" for c in "ijk" if len({a, b, c}) == 3]
    out = None
    for kind, df, cols in parts:
        rows = df.select(F.lit(kind).alias("kind"), ref(*cols).alias("ref"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def info(cons: DataFrame, bus: DataFrame, area: DataFrame | None, known: DataFrame, key: str = "con_id") -> DataFrame:
    """cons with unique_areas, bus_numbers, lowest_voltage, highest_voltage, and for each kind what is named and what of that is undefined."""
    refs = references(cons, key=key)
    marked = refs.join(known.withColumn("_known", F.lit(True)), ["kind", "ref"], "left")
    kinds = {"bus": "buses", "branch": "branches", "transformer": "transformers", "generator": "generators", "load": "loads"}
    pick = lambda k, extra=F.lit(True): F.sort_array(F.collect_set(F.when((F.col("kind") == k) & extra, F.col("ref"))))
    lists = marked.groupBy(key).agg(*[pick(k).alias(n) for k, n in kinds.items() if k != "bus"], *[pick(k, F.col("_known").isNull()).alias(f"undefined_{n}") for k, n in kinds.items()])
    own = bus.select("ibus", "baskv", "area")
    if area is not None:
        own = own.join(area.select(F.col("iarea").alias("area"), "arname"), "area", "left")
    else:
        own = own.withColumn("arname", F.col("area").cast("string"))
    numbers = refs.where("kind = 'bus'").select(key, F.col("ref").cast("long").alias("ibus"))
    volts = numbers.join(own, "ibus", "left").groupBy(key).agg(F.sort_array(F.collect_set("ibus")).alias("bus_numbers"), F.sort_array(F.collect_set("arname")).alias("unique_areas"), F.coalesce(F.min("baskv"), F.lit(0.0)).alias("lowest_voltage"), F.coalesce(F.max("baskv"), F.lit(0.0)).alias("highest_voltage"))
    out = cons.join(volts, key, "left").join(lists, key, "left")
    empty = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in out.schema if f.name not in cons.columns and f.dataType.typeName() == "array"}
    return out.withColumns(empty | {c: F.coalesce(c, F.lit(0.0)) for c in ("lowest_voltage", "highest_voltage")})


def voltage_filter(rows: DataFrame, kv=CONTINGENCY_KV, keep=CONTINGENCY_KEEP, text: str = "text") -> DataFrame:
    band = (F.col("lowest_voltage") >= kv[0]) & (F.col("highest_voltage") >= kv[-1])
    return rows.where(band | F.col(text).rlike("|".join(keep)))


def drop_repeated(cons: DataFrame, text: str = "text") -> DataFrame:
    return cons.where(~F.col(text).rlike(SAID_REPEATED))


_UNDEFINED = ("undefined_buses", "undefined_branches", "undefined_transformers", "undefined_generators", "undefined_loads")


def good(rows: DataFrame) -> DataFrame:
    out = rows
    for c in _UNDEFINED:
        out = out.where(F.size(c) == 0)
    return out


def bad(rows: DataFrame) -> DataFrame:
    return rows.where(" or ".join(f"size({c}) > 0" for c in _UNDEFINED))


def by_area(rows: DataFrame) -> DataFrame:
    """A row for each definition and area that it touches."""
    return rows.withColumn("area_name", F.explode("unique_areas"))


def duplicates(cons: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """All rows whose text occurs more than once, with the number of occurrences."""
    n = cons.groupBy(text).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    return cons.join(n, text).select(*order, text, "occurrences")


def first_of_each(cons: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """The first row of each text in the given order."""
    first = cons.groupBy(text).agg(F.min(F.struct(*order)).alias("_first"))
    return cons.join(first, text).where(F.struct(*order) == F.col("_first")).drop("_first")


def run(cons: DataFrame, network, key: str = "con_id", kv=CONTINGENCY_KV, keep=CONTINGENCY_KEEP, text: str = "text") -> dict[str, DataFrame]:
    """The whole of it, a table for each result. rows: all definitions that are not said to be repeated, with what they name; kept:
    those in the voltage band; removed: the others; good and bad: kept ones of which all or not all is known; by_area: good ones for
    each area they touch, bad_by_area the same of bad ones; duplicates: kept ones whose text occurs more than once."""
    three = network.get("transformer") if "transformer" in network else None
    known = known_references(network["bus"], network.get("acline"), three, network.get("generator"), network.get("load"))
    rows = stored(info(drop_repeated(cons, text), network["bus"], network.sections.get("area"), known, key))
    kept = voltage_filter(rows, kv, keep, text)
    removed = rows.join(kept.select(key), key, "left_anti")
    fine, poor = good(kept), bad(kept)
    return {"rows": rows, "kept": kept, "removed": removed, "good": fine, "bad": poor, "by_area": by_area(fine), "bad_by_area": by_area(poor), "duplicates": duplicates(kept, [key], text)}


def numbered_blocks(lines: DataFrame) -> DataFrame:
    """Definitions of whole files (path, value): path, position, text."""
    return lines.select("path", F.posexplode(F.regexp_extract_all("value", F.lit(DEFINITION), F.lit(0))).alias("position", "text"))


def rank_in_file(cons: DataFrame) -> DataFrame:
    return cons.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("position")))

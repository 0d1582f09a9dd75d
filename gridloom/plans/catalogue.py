"""Queries on the derived grid, one for each operator, and the same in SQL for a second engine."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import FLOWGATE_HOPS
from gridloom.functions import scalar
from gridloom.operators import compare, contingency, flowgate, inch, topology
from gridloom.operators.network import Network
from gridloom.plans.views import views, with_views
from gridloom.sources import files, models, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NATIVE = [1, 2, 3, 4, 5, 11, 12, 13]
NATIVE_SQL = "(1,2,3,4,5,11,12,13)"
FIELDS = ["name", "baskv", "area"]


def query(name: str, uses: list[str], sql: str | None, keep: tuple[str, ...] = ()):
    """Registers a query that is given the views it uses, as a dict. keep: views that it reads more than once, which are written first."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(views(spark, sf_dir, *uses, keep=keep))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_views(uses, sql)
        return f

    return wrap


def _network(v: dict[str, DataFrame]) -> Network:
    return Network({k: d for k, d in v.items() if k in ("bus", "acline", "transformer", "generator", "load", "area")})


_KV = "concat(regexp_replace(printf('%.6f', {0}.baskv), '\\.?0+$', ''), 'kV')"
_SEG = "case when {0}.name is not null then concat(trim({0}.name), ' ', " + _KV + ") end"


@query("scan_bus", ["bus"], "select ibus, name, baskv, area, zone, vm, ide from bus")
def _(v):
    return v["bus"].select("ibus", "name", "baskv", "area", "zone", "vm", "ide")


@query("enrich_acline", ["bus", "area", "acline"], f"select a.*, i.name as ibus_name, i.baskv as ibus_baskv, i.area as ibus_area, ai.arname as ibus_area_name, j.name as jbus_name, j.baskv as jbus_baskv, j.area as jbus_area, aj.arname as jbus_area_name, concat_ws(' ', concat_ws(' - ', {_SEG.format('i')}, {_SEG.format('j')}), concat('CKT ', a.ckt)) as derived_name from acline a left join bus i on i.ibus=a.ibus left join area ai on ai.iarea=i.area left join bus j on j.ibus=a.jbus left join area aj on aj.iarea=j.area")
def _(v):
    return _network(v).with_bus("acline", fields=FIELDS)


@query("enrich_transformer", ["bus", "transformer"], f"select t.*, i.name as ibus_name, i.baskv as ibus_baskv, i.area as ibus_area, j.name as jbus_name, j.baskv as jbus_baskv, j.area as jbus_area, k.name as kbus_name, k.baskv as kbus_baskv, k.area as kbus_area, concat_ws(' ', concat_ws(' - ', {_SEG.format('i')}, {_SEG.format('j')}, {_SEG.format('k')}), concat('CKT ', t.ckt)) as derived_name from transformer t left join bus i on i.ibus=t.ibus left join bus j on j.ibus=t.jbus left join bus k on k.ibus=t.kbus")
def _(v):
    return _network(v).with_bus("transformer", fields=FIELDS)


@query("derived_name", ["bus", "generator"], f"select g.ibus, machid, concat_ws(' - ', {_SEG.format('b')}, machid) as derived_name from generator g left join bus b on b.ibus=g.ibus")
def _(v):
    return _network(v).with_bus("generator", fields=FIELDS).select("ibus", "machid", "derived_name")


@query("enrich_filtered", ["bus", "acline"], "select a.ibus, a.jbus, a.rate1, i.area as ibus_area, j.area as jbus_area from acline a left join bus i on i.ibus=a.ibus left join bus j on j.ibus=a.jbus where a.rate1 >= 40 and a.rpu < 0.05")
def _(v):
    return _network(v).with_bus("acline", "rate1 >= 40 and rpu < 0.05", ["area"]).select("ibus", "jbus", "rate1", "ibus_area", "jbus_area")


@query("filter_area_bus", ["bus"], f"select ibus, area from bus where area in {NATIVE_SQL}")
def _(v):
    return _network(v).filter_by_area(NATIVE)["bus"].select("ibus", "area")


@query("filter_area_acline_anybus", ["bus", "acline"], "select ibus, jbus, ckt from acline where ibus in (select ibus from bus where area in (1,2)) or jbus in (select ibus from bus where area in (1,2))")
def _(v):
    return _network(v).filter_by_area([1, 2])["acline"].select("ibus", "jbus", "ckt")


@query("filter_kv_equipment", ["bus", "transformer", "generator"], "select 'transformer' as section, ibus, jbus, kbus from transformer where ibus in (select ibus from bus where baskv>=230 and baskv<345) or jbus in (select ibus from bus where baskv>=230 and baskv<345) or kbus in (select ibus from bus where baskv>=230 and baskv<345) union all select 'generator', ibus, null, null from generator where ibus in (select ibus from bus where baskv>=230 and baskv<345)")
def _(v):
    n = _network(v).filter_by_kv(230, 345)
    none = F.lit(None).cast("long")
    return n["transformer"].select(F.lit("transformer").alias("section"), "ibus", "jbus", "kbus").union(n["generator"].select(F.lit("generator"), "ibus", none, none))


@query("where_translator", ["bus"], "select ibus, baskv, area, zone, ide from bus where baskv >= 345 and (area in (11,12,13) or zone <> 4) and not ide = 2 and ibus % 1000000 > 5")
def _(v):
    return _network(v).filter_section("bus", "baskv >= 345 and (area.isin([11, 12, 13]) or zone != 4) and not (ide == 2) and ibus % 1000000 > 5")["bus"].select("ibus", "baskv", "area", "zone", "ide")


_TIES = f"from acline a left join bus i on i.ibus=a.ibus left join bus j on j.ibus=a.jbus where coalesce(i.area in {NATIVE_SQL}, false) <> coalesce(j.area in {NATIVE_SQL}, false)"


@query("tie_lines", ["bus", "acline"], f"select a.ibus, a.jbus, a.ckt, i.area as ibus_area, j.area as jbus_area {_TIES}")
def _(v):
    return _network(v).tie_lines(NATIVE).select("ibus", "jbus", "ckt", "ibus_area", "jbus_area")


@query("tie_lines_kv", ["bus", "acline"], f"select a.ibus, a.jbus, i.baskv as ibus_baskv, j.baskv as jbus_baskv {_TIES} and i.baskv between 230 and 500 and j.baskv between 230 and 500")
def _(v):
    return _network(v).tie_lines(NATIVE, 230, 500).select("ibus", "jbus", "ibus_baskv", "jbus_baskv")


_B = "concat('bus:', cast({} as varchar))"
_SHARED_EDGES = f"select {_B.format('ibus')} as src, {_B.format('jbus')} as dst, 'acline' as section, concat_ws(':', 'acline', ibus, jbus, ckt) as id from acline union all select {_B.format('ibus')}, concat_ws(':', 'generator', ibus, machid), 'generator', concat_ws(':', 'generator', ibus, machid) from generator union all select {_B.format('ibus')}, concat_ws(':', 'load', ibus, loadid), 'load', concat_ws(':', 'load', ibus, loadid) from load"
_TID = "concat_ws(':', 'transformer', ibus, jbus, kbus, ckt)"
_T2 = "concat_ws(':', 'transformer', ibus, jbus)"


@query("edges_triangle", ["acline", "transformer", "generator", "load"], _SHARED_EDGES + "".join(f" union all select {_B.format(a)}, {_B.format(b)}, 'transformer', {_TID} from transformer {w}" for a, b, w in (("ibus", "jbus", ""), ("jbus", "kbus", "where kbus<>0"), ("ibus", "kbus", "where kbus<>0"))))
def _(v):
    return topology.edges(v, "triangle")


@query("edges_as_built", ["acline", "transformer", "generator", "load"], _SHARED_EDGES + f" union all select {_B.format('ibus')}, case when kbus<>0 then {_TID} else {_T2} end, 'transformer', {_TID} from transformer union all select {_B.format('jbus')}, case when kbus<>0 then {_TID} else {_T2} end, 'transformer', {_TID} from transformer union all select {_B.format('kbus')}, {_T2}, 'transformer', {_TID} from transformer where kbus<>0")
def _(v):
    return topology.edges(v, "as_built")


@query("nodes", ["bus", "generator", "load"], f"select {_B.format('ibus')} as node, 'bus' as kind from bus union select concat_ws(':', 'generator', ibus, machid), 'generator' from generator union select concat_ws(':', 'load', ibus, loadid), 'load' from load")
def _(v):
    return topology.nodes(v)


_PAIRS = ", pairs as (select ibus as x, jbus as y from acline union select ibus, jbus from transformer union select jbus, kbus from transformer where kbus<>0 union select ibus, kbus from transformer where kbus<>0), both_ways as (select x, y from pairs union select y, x from pairs)"


@query("hops_n2", ["bus", "acline", "transformer"], _PAIRS + ", walk as (select min(ibus) as node, 0 as hop from bus union select y, hop+1 from walk join both_ways on x=node where hop<2) select node as ibus, min(hop) as hop from walk group by node")
def _(v):
    return _network(v).within_hops(v["bus"].agg(F.min("ibus").alias("ibus")), 2)


@query("hops_keyed", ["bus", "acline"], ", both_ways as (select ibus as x, jbus as y from acline union select jbus, ibus from acline), walk as (select area, min(ibus) as node, 0 as hop from bus group by area union select area, y, hop+1 from walk join both_ways on x=node where hop<3) select area, node, min(hop) as hop from walk where node in (select x from both_ways) group by area, node")
def _(v):
    return topology.hops(topology.flowgate_edges({"acline": v["acline"]}), v["bus"].groupBy("area").agg(F.min("ibus").alias("node")), 3, ["area"])


_NEAR1 = _PAIRS + ", near as (select min(ibus) as ibus from bus union select y from both_ways where x=(select min(ibus) from bus))"


@query("neighborhood_flat", ["bus", "acline", "transformer", "generator"], _NEAR1 + " select 'bus' as section, ibus, null as jbus, null as kbus, baskv, null as pt from bus where ibus in (from near) union all select 'acline', ibus, jbus, null, null, null from acline where ibus in (from near) or jbus in (from near) union all select 'transformer', ibus, jbus, kbus, null, null from transformer where ibus in (from near) or jbus in (from near) or kbus in (from near) union all select 'generator', ibus, null, null, null, pt from generator where ibus in (from near)", keep=("acline", "transformer"))
def _(v):
    seeds = v["bus"].agg(F.min("ibus").alias("ibus"))
    return _network(v).neighborhood(seeds, 1, "dataframe").select("section", "ibus", "jbus", "kbus", "baskv", "pt")


_TIE_NEAR = f", ties as (select a.ibus as ibus, a.jbus as jbus {_TIES} and i.baskv >= 500 and j.baskv >= 500), ends as (select ibus from ties union select jbus from ties), near as (select ibus from ends union select jbus from acline where ibus in (from ends) union select ibus from acline where jbus in (from ends)), own as (select ibus from bus where ibus in (from near) and {{}}), held as (select * from acline where ibus in (from near) or jbus in (from near)) select 'bus' as section, ibus, null as jbus from own union all select 'acline', ibus, jbus from held where ibus in (from own) or jbus in (from own)"


def _tie_near(v, side):
    n = _network(v).tie_line_neighborhood(1, NATIVE, side, kv_min=500)
    return n["bus"].select(F.lit("bus").alias("section"), "ibus", F.lit(None).cast("long").alias("jbus")).union(n["acline"].select(F.lit("acline"), "ibus", "jbus"))


@query("tie_neighborhood_internal", ["bus", "acline"], _TIE_NEAR.format(f"area in {NATIVE_SQL}"))
def _(v):
    return _tie_near(v, "internal")


@query("tie_neighborhood_external", ["bus", "acline"], _TIE_NEAR.format(f"area not in {NATIVE_SQL}"))
def _(v):
    return _tie_near(v, "external")


@query("bus_num_changes", ["bus", "bus2"], "select a.ibus as ibus_model1, b.ibus as ibus_model2, a.name, a.area, a.baskv from bus a join bus2 b on a.name is not distinct from b.name and a.area is not distinct from b.area and a.baskv is not distinct from b.baskv where a.ibus<>b.ibus")
def _(v):
    return compare.bus_num_changes(v["bus"], v["bus2"])


_PRES = "case when a.{0} is not null and b.{0} is not null then 'both' when a.{0} is not null then 'model1_only' else 'model2_only' end as presence"


@query("diff_bus", ["bus", "bus2"], f"select coalesce(a.ibus,b.ibus) as ibus, a.name as name_model1, b.name as name_model2, a.name is distinct from b.name as name_delta, a.vm as vm_model1, b.vm as vm_model2, b.vm-a.vm as vm_delta, a.area as area_model1, b.area as area_model2, b.area-a.area as area_delta, {_PRES.format('ibus')} from bus a full join bus2 b on a.ibus=b.ibus")
def _(v):
    return compare.diff_section(v["bus"].select("ibus", "name", "vm", "area"), v["bus2"].select("ibus", "name", "vm", "area"), ["ibus"])


@query("diff_acline", ["acline", "acline2"], f"select coalesce(a.ibus,b.ibus) as ibus, coalesce(a.jbus,b.jbus) as jbus, coalesce(a.ckt,b.ckt) as ckt, a.rate1 as rate1_model1, b.rate1 as rate1_model2, b.rate1-a.rate1 as rate1_delta, a.rpu as rpu_model1, b.rpu as rpu_model2, b.rpu-a.rpu as rpu_delta, {_PRES.format('ibus')} from acline a full join acline2 b on a.ibus=b.ibus and a.jbus=b.jbus and a.ckt=b.ckt")
def _(v):
    return compare.diff_section(v["acline"], v["acline2"], ["ibus", "jbus", "ckt"])


@query("diff_presence_counts", ["bus", "bus2"], f"select presence, count(*) as n from (select {_PRES.format('ibus')} from bus a full join bus2 b on a.ibus=b.ibus) t group by presence")
def _(v):
    return compare.diff_section(v["bus"].select("ibus"), v["bus2"].select("ibus"), ["ibus"]).groupBy("presence").agg(F.count(F.lit(1)).alias("n"))


_E12 = ", e1 as (select distinct ibus as a, jbus as b from acline), e2 as (select distinct least(ibus,jbus) as a, greatest(ibus,jbus) as b from acline2)"


def _pairs(df):
    return topology.canonical(df.select(F.col("ibus").alias("x"), F.col("jbus").alias("y")))


@query("added_removed_edges", ["acline", "acline2"], _E12 + " select 'removed' as change, a, b from e1 where not exists (select 1 from e2 where e2.a=e1.a and e2.b=e1.b) union all select 'added', a, b from e2 where not exists (select 1 from e1 where e2.a=e1.a and e2.b=e1.b)")
def _(v):
    gone, new = compare.edge_changes(_pairs(v["acline"]), _pairs(v["acline2"]))
    return gone.select(F.lit("removed").alias("change"), "a", "b").union(new.select(F.lit("added"), "a", "b"))


@query("added_removed_nodes", ["bus", "bus2"], "select 'removed' as change, ibus from bus where ibus not in (select ibus from bus2) union all select 'added', ibus from bus2 where ibus not in (select ibus from bus)")
def _(v):
    a, b = v["bus"].select("ibus"), v["bus2"].select("ibus")
    return a.join(b, "ibus", "left_anti").select(F.lit("removed").alias("change"), "ibus").union(b.join(a, "ibus", "left_anti").select(F.lit("added"), "ibus"))


@query("alt_paths", ["acline", "acline2"], _E12 + """, n1 as (select a as node from e1 union select b from e1), n2 as (select a as node from e2 union select b from e2), fresh as (select node from n2 where node not in (select node from n1)),
way as (select a as x, b as y from e2 union select b, a from e2), gone as (select a, b from e1 where not exists (select 1 from e2 where e2.a=e1.a and e2.b=e1.b) and a in (from n2) and b in (from n2)),
walk as (select a, b, a as last, [a] as path from gone union all select w.a, w.b, y, list_append(path, y) from walk w join way on x=last where last<>w.b and not list_contains(path, y) and (y=w.b or y in (from fresh)) and len(path)<=5),
found as (select a, b, path, len(path)-1 as edges from walk where last=b) select a, b, array_to_string(path, ' -> ') as path, cast(edges as bigint) as edges from found f where edges=(select min(edges) from found g where g.a=f.a and g.b=f.b)""")
def _(v):
    e1, e2 = _pairs(v["acline"]), _pairs(v["acline2"])
    n1, n2 = (e.select(F.explode(F.array("a", "b")).alias("node")).distinct() for e in (e1, e2))
    paths = compare.alternate_paths(compare.edge_changes(e1, e2)[0], e2, n1, n2)
    return paths.select("a", "b", compare.path_text(F.col("path")).alias("path"), F.col("edges").cast("long").alias("edges"))


_LABEL = "concat(trim({0}.name), ' (', {0}.ibus, ') [', regexp_replace(printf('%.6f', {0}.baskv), '\\.?0+$', ''), ' kV, ide=', {0}.ide, ']')"


@query("path_labels", ["bus", "bus2", "acline"], f", known as (select ibus, {_LABEL.format('bus')} as label from bus union all select ibus, {_LABEL.format('bus2')} from bus2 where ibus not in (select ibus from bus)) select a.ibus, a.jbus, concat(i.label, ' - ', j.label) as original_path_named, concat(i.label, ' -> ', j.label) as path_named from acline a join known i on i.ibus=a.ibus join known j on j.ibus=a.jbus where a.rate1=49")
def _(v):
    node = topology.bus_node
    paths = v["acline"].where("rate1 = 49").select(node("ibus").alias("a"), node("jbus").alias("b"), F.array(node("ibus"), node("jbus")).alias("path"))
    named = compare.named_paths(paths, compare.bus_labels([v["bus"], v["bus2"]]))
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    return named.select(number("a").alias("ibus"), number("b").alias("jbus"), "original_path_named", "path_named")


@query("diff_by_position", ["area"], "select a.position, a.arname as arname_model1, b.arname as arname_model2, a.arname is distinct from b.arname as arname_delta, case when b.position is null then 'model1_only' else 'both' end as presence from (select arname, row_number() over (order by arname) - 1 as position from area) a left join (select arname, row_number() over (order by arname) - 1 as position from area where iarea <> 12) b on a.position=b.position")
def _(v):
    names = v["area"].select("iarea", "arname")
    return compare.diff_by_position(names.select("arname"), names.where("iarea <> 12").select("arname")).withColumn("position", F.col("position").cast("long"))


@query("shortest_path", ["bus", "acline"], ", both_ways as (select ibus as x, jbus as y from acline union select jbus, ibus from acline), walk as (select min(ibus) as node, 0 as hop from bus where ibus in (select x from both_ways) union select y, hop+1 from walk join both_ways on x=node where hop<6) select min(hop) as edges from walk where node = (select max(ibus) from bus where ibus in (select x from both_ways))", keep=("acline",))
def _(v):
    pairs = topology.flowgate_edges({"acline": v["acline"]})
    ends = pairs.select(F.explode(F.array("a", "b")).alias("n")).agg(F.min("n"), F.max("n")).first()
    edges = topology.shortest_hops(pairs, ends[0], ends[1])
    return pairs.sparkSession.createDataFrame([(edges,)], "edges int")


@query("intersect_sections", ["acline", "acline2"], "select ibus, jbus, ckt from acline intersect select ibus, jbus, ckt from acline2")
def _(v):
    keys = ["ibus", "jbus", "ckt"]
    return compare.diff_section(v["acline"].select(*keys), v["acline2"].select(*keys), keys).where("presence = 'both'").select(*keys)


@query("unpivot_diff", ["bus", "bus2"], "select ibus, 'vm' as field, a.vm as model1, b.vm as model2, b.vm-a.vm as delta from bus a join bus2 b using (ibus) where a.vm is distinct from b.vm union all select ibus, 'baskv', a.baskv, b.baskv, b.baskv-a.baskv from bus a join bus2 b using (ibus) where a.baskv is distinct from b.baskv")
def _(v):
    cols = ["ibus", "vm", "baskv"]
    return compare.unpivoted(compare.diff_section(v["bus"].select(*cols), v["bus2"].select(*cols), ["ibus"]).where("presence = 'both'"), ["ibus"], ["vm", "baskv"])


@query("bus_kv_filter", ["bus", "bus2", "generator", "load"], "select coalesce(a.ibus,b.ibus) as ibus from bus a full join bus2 b on a.ibus=b.ibus where (a.baskv between 138 and 10000 or b.baskv between 138 and 10000) and coalesce(a.ibus,b.ibus) in (select ibus from generator union select ibus from load)")
def _(v):
    diff = compare.diff_section(v["bus"].select("ibus", "baskv"), v["bus2"].select("ibus", "baskv"), ["ibus"])
    return compare.kv_buses(diff, [v["generator"].select("ibus"), v["load"].select("ibus")], 138, 10_000)


@query("query_diff_filter", ["bus", "bus2", "generator", "load"], "select coalesce(a.ibus,b.ibus) as ibus, a.baskv as baskv_model1, b.vm-a.vm as vm_delta from bus a full join bus2 b on a.ibus=b.ibus where (a.baskv between 138 and 10000 or b.baskv between 138 and 10000) and coalesce(a.ibus,b.ibus) in (select ibus from generator union select ibus from load) and a.baskv >= 138 and (a.ibus is null or b.ibus is null or b.vm-a.vm > 0)")
def _(v):
    load = v["load"]
    one = Network({"bus": v["bus"].select("ibus", "name", "baskv", "area", "vm"), "generator": v["generator"], "load": load})
    two = Network({"bus": v["bus2"].select("ibus", "name", "baskv", "area", "vm"), "generator": v["generator"], "load": load})
    found = compare.Comparison(one, two).query({"bus": "baskv_model1 >= 138 and (presence != 'both' or vm_delta > 0)"})
    return found["bus"].select("ibus", "baskv_model1", "vm_delta")


# Flowgates. Tokens name buses that are called B<number>.

_FG = ["named_bus", "acline", "transformer", "generator", "elements"]
_RES = """, look as (select trim(name) as n, round(baskv,3) as k, max(ibus) as ibus from named_bus group by 1, 2),
known as (select least(ibus,jbus) as i, greatest(ibus,jbus) as j, ckt from acline union select least(ibus,jbus), greatest(ibus,jbus), ckt from transformer where kbus=0),
tried as (select e.*, f.ibus as fb, t.ibus as tb, m.ibus as mb from elements e left join look f on f.n=trim(substring(from_token,1,12)) and f.k=try_cast(trim(substring(from_token,13,6)) as double) left join look t on t.n=trim(substring(to_token,1,12)) and t.k=try_cast(trim(substring(to_token,13,6)) as double) left join look m on m.n=trim(substring(bus_token,1,12)) and m.k=try_cast(trim(substring(bus_token,13,6)) as double)),
judged as (select *, case when element_type='branch' and (fb is null or tb is null) then 'bus_not_found' when element_type='branch' and not exists (select 1 from known where i=least(fb,tb) and j=greatest(fb,tb) and ckt=ckt_id) then 'branch_not_found' when element_type='generator' and mb is null then 'bus_not_found' when element_type='generator' and not exists (select 1 from generator g where g.ibus=mb and g.machid=machine_id) then 'generator_not_found' end as reason from tried)"""
_SEEDS = _RES + ", seeds as (select distinct flowgate_id, role, unnest([coalesce(fb,mb), tb]) as node from judged where reason is null)"
_BOTH = ", pairs as (select ibus as x, jbus as y from acline union select ibus, jbus from transformer union select jbus, kbus from transformer where kbus<>0 union select ibus, kbus from transformer where kbus<>0), both_ways as (select x, y from pairs union select y, x from pairs)"
_HOP0 = _SEEDS + _BOTH + ", near0 as (select flowgate_id, role, node as ibus from seeds where node is not null)"
_HOPS = "".join(f", near{k + 1} as (select * from near{k} union select flowgate_id, role, y from near{k} join both_ways on x=ibus)" for k in range(FLOWGATE_HOPS))
_FNEAR = _HOP0 + ", near as (select * from near0 union select flowgate_id, role, y from near0 join both_ways on x=ibus)"


def _resolve(v):
    return flowgate.resolve(v["elements"], v["named_bus"], v["acline"], v["transformer"], v["generator"])


def _near(v, hops=1):
    return flowgate.neighborhoods(_resolve(v)[0], v["named_bus"], v["acline"], v["transformer"], hops)


@query("flowgate_by_sc", ["elements"], "select flowgate_id, description, role, element_type from elements where sc='SCA'")
def _(v):
    return flowgate.by_sc(v["elements"], "SCA").select("flowgate_id", "description", "role", "element_type")


@query("flowgate_resolved", _FG, _RES + " select flowgate_id, role, element_type, coalesce(fb,mb) as ibus, tb as jbus from judged where reason is null")
def _(v):
    return _resolve(v)[0]


@query("flowgate_unresolved", _FG, _RES + " select flowgate_id, role, element_type, from_token, to_token, ckt_id, bus_token, machine_id, reason from judged where reason is not null")
def _(v):
    return _resolve(v)[1]


@query("flowgate_neighborhood", _FG, _HOP0 + _HOPS + f" select flowgate_id, role, ibus from near{FLOWGATE_HOPS}", keep=("item_pairs", "acline", "transformer"))
def _(v):
    return _near(v, FLOWGATE_HOPS)


# Reinforced seeds: buses that no line or transformer joins are near themselves only.
@query("flowgate_isolated", ["named_bus", "acline", "transformer"], _BOTH + " select 1 as flowgate_id, 'monitor' as role, ibus from named_bus where ibus not in (select x from both_ways)", keep=("acline", "transformer"))
def _(v):
    pairs = topology.flowgate_edges(v)
    joined = pairs.select(F.explode(F.array("a", "b")).alias("ibus")).distinct()
    alone = v["named_bus"].join(joined, "ibus", "left_anti").select(F.lit(1).alias("flowgate_id"), F.lit("monitor").alias("role"), "ibus", F.lit(None).cast("long").alias("jbus"))
    return flowgate.neighborhoods(alone, v["named_bus"], v["acline"], v["transformer"], 2)


@query("flowgate_branches", _FG, _FNEAR + ", lines as (select ibus, jbus, ckt, 'line' as kind from acline union all select ibus, jbus, ckt, 'transformer_2w' from transformer where kbus=0) select flowgate_id, role, kind as equipment_type, i.name as from_name, i.baskv as from_volt, i.area as from_area, j.name as to_name, j.baskv as to_volt, j.area as to_area, ckt as ckt_id from (select distinct flowgate_id, role, l.* from near n join lines l on n.ibus=l.ibus or n.ibus=l.jbus) x left join named_bus i on i.ibus=x.ibus left join named_bus j on j.ibus=x.jbus where i.baskv between 160 and 765 or j.baskv between 160 and 765", keep=("acline", "transformer"))
def _(v):
    return flowgate.branches(_near(v), v["named_bus"], v["acline"], v["transformer"])


@query("flowgate_generators", _FG, _HOP0 + _HOPS + f" select flowgate_id, role, b.name as bus_name, b.baskv as volt, b.area as area, machid as ckt_id from near{FLOWGATE_HOPS} n join generator g on g.ibus=n.ibus left join named_bus b on b.ibus=g.ibus where pt>=15", keep=("item_pairs", "acline", "transformer"))
def _(v):
    return flowgate.near_generators(_resolve(v)[0], v["named_bus"], v["acline"], v["transformer"], v["generator"])


@query("flowgate_3w", _FG, _FNEAR + " select flowgate_id, role, cast(null as varchar) as transformer_name, i.name as w1_bus_name, i.baskv as w1_volt, j.name as w2_bus_name, j.baskv as w2_volt, k.name as w3_bus_name, k.baskv as w3_volt, ckt as ckt_id from (select distinct flowgate_id, role, t.* from near n join transformer t on t.kbus<>0 and (n.ibus=t.ibus or n.ibus=t.jbus or n.ibus=t.kbus)) x left join named_bus i on i.ibus=x.ibus left join named_bus j on j.ibus=x.jbus left join named_bus k on k.ibus=x.kbus where i.baskv between 160 and 765 or j.baskv between 160 and 765 or k.baskv between 160 and 765", keep=("acline", "transformer"))
def _(v):
    return flowgate.transformers_3w(_near(v), v["named_bus"], v["transformer"])


# Contingencies.

_CON = ["cons", "bus", "acline", "generator", "load", "area"]
_REFS = """, spoken as (select con_id, string_split(line, ' ') as w from (select con_id, unnest(string_split(text, chr(10))) as line from cons)),
refs as (select distinct con_id, 'bus' as kind, w[i + 1] as ref from (select con_id, w, unnest(range(1, len(w))) as i from spoken) where w[i] = 'BUS' union select con_id, 'branch', concat_ws('/', w[5], w[8], w[10]) from spoken where w[1] = 'OPEN' union select con_id, 'generator', concat_ws('/', w[6], w[3]) from spoken where w[2] = 'MACHINE')"""
_JUDGED = _REFS + """, known as (select 'bus' as kind, cast(ibus as varchar) as ref from bus union select 'branch', concat_ws('/', ibus, jbus, ckt) from acline union select 'branch', concat_ws('/', jbus, ibus, ckt) from acline union select 'generator', concat_ws('/', ibus, machid) from generator),
volts as (select con_id, min(baskv) as low, max(baskv) as high from refs join bus on kind='bus' and ref=cast(ibus as varchar) group by con_id), open as (select con_id, kind, ref from refs where (kind, ref) not in (select (kind, ref) from known))"""


def _info(v):
    known = contingency.known_references(v["bus"], v["acline"], None, v["generator"], v["load"])
    return contingency.info(contingency.drop_repeated(v["cons"]), v["bus"], v["area"], known)


@query("contingency_refs", ["cons"], _REFS + " select con_id, kind, ref from refs")
def _(v):
    return contingency.references(v["cons"])


_NOT_REPEATED = "c.text not like '%' || chr(10) || '//%REPEATED%'"


@query("contingency_info", _CON, _JUDGED + f" select c.con_id, coalesce(low, 0.0) as lowest_voltage, coalesce(high, 0.0) as highest_voltage, (select count(*) from open o where o.con_id=c.con_id) as n_undefined from cons c left join volts v on v.con_id=c.con_id where {_NOT_REPEATED}")
def _(v):
    n = sum((F.size(c) for c in contingency._UNDEFINED), F.lit(0)).cast("long")
    return _info(v).select("con_id", "lowest_voltage", "highest_voltage", n.alias("n_undefined"))


@query("contingency_good", _CON, _JUDGED + f" select c.con_id from cons c left join volts v on v.con_id=c.con_id where {_NOT_REPEATED} and not exists (select 1 from open o where o.con_id=c.con_id) and ((low>=138 and high>=160) or text like '%MACHINE%' or text like '%LOAD%')")
def _(v):
    return contingency.good(contingency.voltage_filter(_info(v))).select("con_id")


@query("contingency_bad", _CON, _JUDGED + f" select c.con_id from cons c where {_NOT_REPEATED} and exists (select 1 from open o where o.con_id=c.con_id)")
def _(v):
    return contingency.bad(_info(v)).select("con_id")


@query("contingency_area_fanout", _CON, _JUDGED + f" select distinct c.con_id, arname as area_name from cons c join refs r on r.con_id=c.con_id and kind='bus' join bus b on ref=cast(ibus as varchar) join area a on a.iarea=b.area where {_NOT_REPEATED}")
def _(v):
    return contingency.by_area(_info(v)).select("con_id", "area_name")


@query("dup_contingencies", ["cons"], ", plain as (select con_id, regexp_replace(text, '[0-9]+', '', 'g') as text from cons) select con_id, text, count(*) over (partition by text) as occurrences from plain qualify count(*) over (partition by text) > 1")
def _(v):
    return contingency.duplicates(v["cons"].select("con_id", F.regexp_replace("text", "[0-9]+", "").alias("text")), ["con_id"])


@query("first_contingencies", ["cons"], ", plain as (select con_id, regexp_replace(text, '[0-9]+', '', 'g') as text from cons) select con_id, text from plain qualify row_number() over (partition by text order by con_id) = 1")
def _(v):
    return contingency.first_of_each(v["cons"].select("con_id", F.regexp_replace("text", "[0-9]+", "").alias("text")), ["con_id"]).select("con_id", "text")


# Sources and sinks: sections written in each file format, read back and cast.

_CASE = ("@!IC, SBASE,REV,XFRRAT,NXFRAT,BASFRQ", "0, 100.00, 34, 0, 1, 60.00 / PSS(R)E-34.6", "ONE", "TWO", "GENERAL, THRSHZ=0.0001")


def _text(v, lines: DataFrame, name: str) -> str:
    """The lines (section, place, value), in order, as one file, as its format asks: a task writes it."""
    from gridloom.storage import shared_folder

    path = shared_folder(lines.sparkSession)
    lines.repartition(1).sortWithinPartitions("section", "place", "value").select("value").write.text(path)
    return f"{path}/{name}" if name else path


def _raw_case(v) -> Network:
    spark = v["bus"].sparkSession
    csv = lambda df, *cols: df.select(F.concat_ws(",", *[F.col(c).cast("string") if c not in ("name", "ckt", "machid") else F.concat(F.lit("'"), F.col(c), F.lit("'")) for c in cols]).alias("value"))
    titles = lambda n, text: spark.createDataFrame([(n, 0, t) for t in text], "section int, place int, value string")
    body = lambda n, df: df.select(F.lit(n).alias("section"), F.lit(1).alias("place"), "value")
    head = spark.createDataFrame([(0, k, t) for k, t in enumerate(_CASE)], "section int, place int, value string")
    parts = [head]
    for n, title, names, df in ((1, "BUS", "I,NAME,BASKV,IDE,AREA,ZONE,VM", csv(v["bus"], "ibus", "name", "baskv", "ide", "area", "zone", "vm")), (3, "GENERATOR", "I,ID,PT", csv(v["generator"], "ibus", "machid", "pt")), (5, "BRANCH", "I,J,CKT,R,RATE1", csv(v["acline"], "ibus", "jbus", "ckt", "rpu", "rate1"))):
        parts += [titles(n, [f"0 / END OF SECTION DATA, BEGIN {title} DATA"]), titles(n + 1, [f"@! {names}"]).withColumn("place", F.lit(0)), body(n + 1, df)]
    parts.append(titles(7, ["0 / END OF BRANCH DATA", "Q"]))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return models.network_of(models.read_long(spark, _text(v, lines, "")))


_GRID = ["bus", "generator", "acline"]


@query("source_raw_bus", _GRID, "select ibus, name, baskv, ide, area, zone, vm from bus")
def _(v):
    return _raw_case(v)["bus"].select("ibus", "name", "baskv", F.col("ide").cast("int").alias("ide"), F.col("area").cast("int").alias("area"), F.col("zone").cast("int").alias("zone"), "vm")


@query("source_raw_acline", _GRID, "select ibus, jbus, ckt, cast(rpu as double) as rpu, cast(rate1 as double) as rate1 from acline")
def _(v):
    return _raw_case(v)["acline"].select("ibus", "jbus", "ckt", "rpu", "rate1")


@query("source_raw_generator", _GRID, "select ibus, machid, cast(pt as double) as pt from generator")
def _(v):
    return _raw_case(v)["generator"].select("ibus", "machid", "pt")


@query("source_rawx", ["bus", "area"], "select 'bus' as section, ibus as id, name, baskv from bus union all select 'area', iarea, arname, null from area")
def _(v):
    from gridloom.storage import shared_folder

    spark = v["bus"].sparkSession
    rows = lambda df, *cols: df.select(F.to_json(F.array(*[F.col(c).cast("string") for c in cols])).alias("row")).agg(F.concat_ws(",", F.collect_list("row")).alias("rows"))
    section = lambda name, df, *cols: rows(df, *cols).select(F.concat(F.lit(f'"{name}": {{"fields": {json.dumps(cols)}, "data": ['), F.col("rows"), F.lit("]}")).alias("value"))
    both = section("bus", v["bus"], "ibus", "name", "baskv").unionByName(section("area", v["area"], "iarea", "arname"))
    text = both.agg(F.concat(F.lit('{"general": {"version": "1"}, "network": {'), F.concat_ws(", ", F.collect_list("value")), F.lit("}}")).alias("value"))
    path = shared_folder(spark)
    text.write.text(path)
    net = models.load(spark, text.first()[0])
    assert net.general == {"version": 1} or net.general == {"version": "1"}
    return net["bus"].select(F.lit("bus").alias("section"), F.col("ibus").alias("id"), "name", "baskv").unionByName(net["area"].select(F.lit("area").alias("section"), F.col("iarea").alias("id"), F.col("arname").alias("name"), F.lit(None).cast("double").alias("baskv")))


@query("source_con", ["cons"], "select con_id, text from cons")
def _(v):
    from gridloom.storage import shared_folder

    path = shared_folder(v["cons"].sparkSession)
    v["cons"].select(F.col("text").alias("value")).write.option("lineSep", "\n\n").text(path)
    read = files.read_contingencies(v["cons"].sparkSession, path)
    return read.select(F.regexp_extract("text", r"CONTINGENCY C(\d+)", 1).cast("long").alias("con_id"), "text")


@query("source_ragged", ["bus"], "select cast(ibus as varchar) as id, name, case when area = 1 then cast(zone as varchar) end as extra from bus")
def _(v):
    from gridloom.storage import shared_folder

    path = shared_folder(v["bus"].sparkSession)
    quoted = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    v["bus"].select(F.concat_ws(",", F.col("ibus").cast("string"), quoted, F.when(F.col("area") == 1, F.col("zone").cast("string"))).alias("value")).write.text(path)
    return files.read_ragged(v["bus"].sparkSession, path, ["id", "name", "extra"])


@query("sink_csv", ["acline"], "select cast(ibus as varchar) as ibus, cast(jbus as varchar) as jbus, ckt from acline")
def _(v):
    from gridloom.storage import shared_folder

    path = shared_folder(v["acline"].sparkSession)
    sinks.write_csv(v["acline"].select("ibus", "jbus", "ckt"), path)
    return v["acline"].sparkSession.read.option("header", True).csv(path)


@query("contingency_run", _CON, _JUDGED + f", kept as (select c.con_id, exists (select 1 from open o where o.con_id=c.con_id) as poor, (low>=138 and high>=160) or text like '%MACHINE%' or text like '%LOAD%' as inside from cons c left join volts v on v.con_id=c.con_id where {_NOT_REPEATED}) select case when coalesce(inside, false) then case when poor then 'bad' else 'good' end else 'removed' end as result, con_id from kept")
def _(v):
    found = contingency.run(v["cons"], _network(v))
    return found["good"].select(F.lit("good").alias("result"), "con_id").union(found["bad"].select(F.lit("bad"), "con_id")).union(found["removed"].select(F.lit("removed"), "con_id"))


# Scalars, quality, records.


@query("kv_format", ["bus"], "select distinct baskv, concat(regexp_replace(printf('%.6f', baskv / 10), '\\.?0+$', ''), 'kV') as label, case when baskv>=765 then '765+' when baskv>=500 then '500' when baskv>=230 then '230' when baskv>=115 then '115' when baskv>=69 then '69' else 'low' end as bucket from bus")
def _(v):
    return v["bus"].select("baskv", scalar.format_kv(F.col("baskv") / 10).alias("label"), scalar.kv_bucket(F.col("baskv")).alias("bucket")).distinct()


@query("multi_replace", ["bus"], "select ibus, replace(replace(name, 'a', 'x'), 'xr', 'Q') as name from bus")
def _(v):
    return v["bus"].select("ibus", scalar.multi_replace(F.col("name"), {"a": "x", "xr": "Q"}).alias("name"))


@query("coalesce_cols", ["bus", "generator", "load"], "select b.ibus, coalesce(g.pt, l.pl) as power from bus b left join generator g on g.ibus=b.ibus left join load l on l.ibus=b.ibus")
def _(v):
    both = v["bus"].select("ibus").join(v["generator"].select("ibus", "pt"), "ibus", "left").join(v["load"].select("ibus", "pl"), "ibus", "left")
    return scalar.coalesce_columns(both, "power", "pt", "pl", drop=True)


@query("coerce_types", ["bus"], "select ibus, area, baskv, vm, name from bus")
def _(v):
    text = v["bus"].select(*[F.col(c).cast("string").alias(c) for c in ("ibus", "area", "baskv", "vm", "name")])
    return scalar.coerce(text, ("bigint", "double", "string")).withColumns({"baskv": F.col("baskv").cast("double"), "area": F.col("area").cast("int")})


@query("validate_columns", ["bus"], "select 'baskv' as column_name, case when min(baskv) < 100 then concat('baskv has ', min(baskv), ', under 100') else '' end as message from bus union all select 'ide', '' union all select 'area', case when count(*) filter (area not in (11,12,13)) > 0 then concat('area has ', count(*) filter (area not in (11,12,13)), ' values that are not among those allowed') else '' end from bus")
def _(v):
    bus = v["bus"]
    found = [("baskv", scalar.validate_column(bus, "baskv", low=100)), ("ide", scalar.validate_column(bus, "ide", nullable=False, low=1, high=4, pattern="^[1-4]$")), ("area", scalar.validate_column(bus, "area", isin=[11, 12, 13]))]
    return bus.sparkSession.createDataFrame(found, "column_name string, message string")


@query("inch_records", ["bus", "bus2"], "select ibus, case when ibus not in (select ibus from bus) then concat('#ADD_BUS [BusNum]', chr(10), ibus, chr(10), '#END') else concat('#DELETE_BUS [BusNum]', chr(10), ibus, chr(10), '#END') end as record from (select ibus from bus2 where ibus not in (select ibus from bus) union all select ibus from bus where ibus not in (select ibus from bus2)) t")
def _(v):
    diff = compare.diff_section(v["bus"].select("ibus"), v["bus2"].select("ibus"), ["ibus"])
    add = inch.render(diff.where("presence = 'model2_only'"), "#ADD_BUS", {"BusNum": "ibus"})
    return add.unionByName(inch.render(diff.where("presence = 'model1_only'"), "#DELETE_BUS", {"BusNum": "ibus"})).select("ibus", "record")


@query("inch_from_diff", ["bus", "bus2"], "select coalesce(a.ibus, b.ibus) as ibus, case when b.ibus is null then concat('#DELETE_BUS [BusNum]', chr(10), a.ibus, chr(10), '#END') else concat(case when a.ibus is null then '#ADD' else '#MODIFY' end, '_BUS [BusNum,BusName,BusType]', chr(10), concat_ws(',', b.ibus, b.name, b.ide), chr(10), '#END') end as record from bus a full join bus2 b on a.ibus=b.ibus where a.ibus is null or b.ibus is null or a.name is distinct from b.name or a.ide is distinct from b.ide")
def _(v):
    cols = ["ibus", "name", "ide"]
    return inch.from_diff(compare.diff_section(v["bus"].select(*cols), v["bus2"].select(*cols), ["ibus"]), "BUS").select("ibus", "record")


def _tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as instants, made naive in another zone."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp").alias("ts"))
    return scalar.naive_frame(rows, "Etc/GMT-2")


QUERIES["tz_naive"] = _tz
ORACLE_SQL["tz_naive"] = "select event_id, ts + interval 2 hour as ts from events"

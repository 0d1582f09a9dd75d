"""A grid derived from the order tables: one text that both engines run, used as the input of the catalogue's queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gridloom.storage import release, stored

# Every row of part and lineitem takes part. Buses are parts; lines join the parts of consecutive items of an order; transformers
# those of an order's first three; generation is what was shipped, load what is open. Model 2 lacks buses of size 37, numbers those
# of size 41 anew, changes the voltage of size 13, drops lines rated 50 and splits those rated 49 by a new bus.
VIEWS = {
    "bus": "select p_partkey+1 as ibus, p_name as name, cast(case p_size % 6 when 0 then 765.0 when 1 then 500.0 when 2 then 345.0 when 3 then 230.0 when 4 then 138.0 else 69.0 end as double) as baskv, cast(substring(p_brand,7) as int) as area, p_size % 10 + 1 as zone, p_retailprice/cast(1000 as double) as vm, p_size % 4 + 1 as ide, p_size as size from part",
    "area": "select area as iarea, concat('AREA ', cast(area as varchar(10))) as arname from bus group by area",
    "line_seq": "select *, row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice) as rn from lineitem",
    "item_pairs": "select least(a.l_partkey,b.l_partkey)+1 as ibus, greatest(a.l_partkey,b.l_partkey)+1 as jbus, a.l_suppkey as supp, a.l_quantity as q, a.l_discount as d from line_seq a join line_seq b on a.l_orderkey=b.l_orderkey and b.rn=a.rn+1 where a.l_partkey<>b.l_partkey",
    "acline": "select ibus, jbus, '1' as ckt, max(q) as rate1, min(d) as rpu from item_pairs group by ibus, jbus",
    "transformer": "select distinct i as ibus, j as jbus, coalesce(k,0) as kbus, '1' as ckt from (select max(case when rn=1 then l_partkey+1 end) i, max(case when rn=2 then l_partkey+1 end) j, max(case when rn=3 then l_partkey+1 end) k from line_seq group by l_orderkey) t where j is not null and i<>j and (k is null or (k<>i and k<>j))",
    "generator": "select l_partkey+1 as ibus, '1' as machid, sum(l_quantity) as pt from lineitem where l_linestatus='F' group by l_partkey",
    "load": "select l_partkey+1 as ibus, '1' as loadid, sum(l_quantity) as pl from lineitem where l_linestatus='O' group by l_partkey",
    "bus2": "select case when size=41 then ibus+1000000 else ibus end as ibus, name, baskv, area, zone, case when size=13 then vm*cast(1.1 as double) else vm end as vm, ide, size from bus where size<>37 union all select 5000000000+ibus*100000+jbus, 'SPLIT', cast(345 as double), 1, 1, cast(1 as double), 1, 0 from acline where rate1=49",
    "acline2": "select ibus,jbus,ckt,rate1,rpu from acline where rate1<49 union all select ibus, 5000000000+ibus*100000+jbus, ckt, rate1, rpu from acline where rate1=49 union all select 5000000000+ibus*100000+jbus, jbus, ckt, rate1, rpu from acline where rate1=49",
    "named_bus": "select ibus, concat('B', cast(ibus as varchar(20))) as name, baskv, area from bus",
    "picks": "select supp, min(ibus*10000000+jbus) as first_line, max(ibus*10000000+jbus) as last_line, min(ibus) as machine_bus from item_pairs group by supp",
    "tokens": "select ibus, concat(rpad(concat('B', cast(ibus as varchar(20))), 12, ' '), rpad(cast(baskv as varchar(10)), 6, ' ')) as token from bus",
    "elements": "select supp as flowgate_id, concat('FG ', cast(supp as varchar(10))) as description, case when s_acctbal > 5000 then 'SCA' else 'SCB' end as sc, role, element_type, a.token as from_token, case when s_nationkey > 20 and role='contingency' then 'NOWHERE     500.0 ' else b.token end as to_token, ckt_id, c.token as bus_token, machine_id from (select supp, 'monitor' as role, 'branch' as element_type, cast(floor(first_line/10000000) as bigint) as i, first_line % 10000000 as j, '1' as ckt_id, cast(null as bigint) as g, cast(null as varchar(5)) as machine_id from picks union all select supp, 'contingency', 'branch', cast(floor(last_line/10000000) as bigint), last_line % 10000000, '2', cast(null as bigint), cast(null as varchar(5)) from picks union all select supp, 'contingency', 'generator', cast(null as bigint), cast(null as bigint), cast(null as varchar(5)), machine_bus, '1' from picks union all select supp, 'contingency', 'generator', cast(null as bigint), cast(null as bigint), cast(null as varchar(5)), machine_bus, '9' from picks) e join supplier on s_suppkey=supp left join tokens a on a.ibus=i left join tokens b on b.ibus=j left join tokens c on c.ibus=g",
    "cons": "select supp as con_id, concat('CONTINGENCY C', cast(supp as varchar(10)), chr(10), 'OPEN BRANCH FROM BUS ', cast(cast(floor(first_line/10000000) as bigint) as varchar(20)), ' TO BUS ', cast(first_line % 10000000 as varchar(20)), ' CKT ', case when s_nationkey > 20 then '7' else '1' end, chr(10), case when s_acctbal > 5000 then concat('REMOVE MACHINE 1 FROM BUS ', cast(machine_bus as varchar(20)), chr(10)) else '' end, case when s_acctbal < 0 then concat('// REPEATED', chr(10)) else '' end, 'END') as text from picks join supplier on s_suppkey=supp",
}
_TABLES = ("part", "lineitem", "supplier", "orders", "nation", "region", "customer", "events")
_USES = {name: [v for v in [*VIEWS, *_TABLES] if v != name and re.search(rf"\b(from|join) {v}\b", sql)] for name, sql in VIEWS.items()}


def needed(names: list[str]) -> list[str]:
    """The views that these build on, and they, in an order in which each comes after what it uses."""
    out: list[str] = []

    def add(name: str) -> None:
        for u in _USES.get(name, []):
            add(u)
        if name in VIEWS and name not in out:
            out.append(name)

    for n in names:
        add(n)
    return out


def with_views(names: list[str], query: str) -> str:
    """The query for DuckDB, its views as common table expressions."""
    return "with recursive " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed(names)) + ("," if query.lstrip().startswith(",") else "\n") + query.lstrip().removeprefix(",")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables of the folder."""
    return views(spark, sf_dir, name)[name]


def views(spark: SparkSession, sf_dir: str, *names: str, keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Views as DataFrames, sharing what they build on. Those in keep are written once and read from there; what was
    shuffled for them is removed."""
    made: dict[str, DataFrame] = {}
    for n in needed(list(names)):
        sources = {u: made[u] if u in made else spark.read.parquet(f"{sf_dir}/{u}.parquet") for u in _USES[n]}
        sql = VIEWS[n]
        for u in sources:
            sql = re.sub(rf"\b(from|join) {u}\b", rf"\1 {{{u}}}", sql)
        made[n] = spark.sql(sql, **sources)
        if n in keep:
            made[n] = stored(made[n])
            release(spark)
    return {n: made[n] for n in names}

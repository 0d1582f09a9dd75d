"""Sources, enrichment, filters and comparison on small hand-made cases."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.functions.predicates import to_column
from gridloom.operators import contingency, flowgate, inch, topology
from gridloom.operators.compare import Comparison, diff_section, reorder
from gridloom.operators.network import Network
from gridloom.registry import REGISTRY, expand, register_section, section
from gridloom.sources import files, models, mon, raw, rawx, sinks

CASE = """@!IC, SBASE,REV,XFRRAT,NXFRAT,BASFRQ
0,   100.00, 34,     0,     1, 60.00     / PSS(R)E-34.6    MON
FIRST TITLE
SECOND TITLE
GENERAL, THRSHZ=0.0001, PQBRAK=0.7, BLOWUP=5.0
SOLVER, FDNS, ACTAPS=0
RATING, 1, "R1", "First, with comma"
0 / END OF SYSTEM-WIDE DATA, BEGIN BUS DATA
@!   I,'NAME        ', BASKV, IDE,AREA,ZONE,OWNER, VM,        VA,    NVHI,   NVLO,   EVHI,   EVLO
   1,'ONE         ', 500.0000,1,   1,   1,   1,1.0, -1.0,1.1,0.9,1.1,0.9
   2,'TWO, B      ',  34.5000,1,   2,   1,   1,1.0, -1.0,1.1,0.9,1.1,0.9
   3,'THREE       ', 230.0000,1,   1,   1,   1,1.0, -1.0,1.1,0.9,1.1,0.9
   4,'FOUR        ', 230.0000,1,   3,   1,   1,1.0, -1.0,1.1,0.9,1.1,0.9
0 / END OF BUS DATA, BEGIN LOAD DATA
@!   I,'ID',STAT,AREA,ZONE,      PL
   2,'1 ',1,1,1,10.5
0 / END OF LOAD DATA, BEGIN BRANCH DATA
@!   I,     J,'CKT',     R,          X,         B,                    'N A M E'                 ,   RATE1
   1,     2,'1 ', 0.1,0.2,0.3,'LINE', 100.0
   3,     1,'2 ', 0.1,0.2,0.3,'', 90.0
0 / END OF BRANCH DATA, BEGIN TRANSFORMER DATA
@!   I,     J,     K,'CKT',CW,CZ,CM,     MAG1,        MAG2,NMETR,               'N A M E',               STAT
@!   R1-2,       X1-2,   SBASE1-2,     R2-3
@!WINDV1,  NOMV1,    ANG1,  RATE1-1,NOD1
@!WINDV2,  NOMV2,    ANG2,  RATE2-1,NOD2
@!WINDV3,  NOMV3,    ANG3,  RATE3-1,NOD3
   1,   3,   0,'T1', 1,1,1, 0.0,0.0,2,'TWO WINDINGS',1
 0.01,0.02,100.0
1.0,500.0,0.0,700.0,5
1.0,230.0
   1,   3,   4,'T2', 1,1,1, 0.0,0.0,2,'THREE WINDINGS',1
 0.01,0.02,100.0,0.03
1.0,500.0,0.0,700.0,5
1.0,230.0,0.0,600.0,6
1.0,230.0,0.0,500.0,7
0 / END OF TRANSFORMER DATA, BEGIN IMPEDANCE CORRECTION DATA
 1,  -30.00, 1.10000, 0.00000,  -24.00, 1.09100, 0.00000, 0.00, 0.00, 0.00
0 / END OF IMPEDANCE CORRECTION DATA, BEGIN MULTI-TERMINAL DC DATA
@!  'NAME',    NCONV,NDCBS,NDCLN,  MDC, VCONV,     VCMOD, VCONVN
@!  IB, N,ANGMX
@!IDC, IB,AREA
@!IDC,JDC,'DCCKT',MET
"DC", 1, 1, 1, 1, 2, 4.0, 0
 3, 4, 10.0
 1, 3, 4
 1, 2, '1', 1
0 / END OF MULTI-TERMINAL DC DATA, BEGIN SUBSTATION DATA
1, 0, SUB_A, 500.0
1, 101, NODE_A, 1, 500.0, 0.0, 500.0
BEGIN SUBSTATION SWITCHING DEVICE DATA
101, 102, 1, 2, 1, BREAKER
0 / END OF SUBSTATION DATA
Q
"""


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("case") / "case.raw"
    path.write_text(CASE, encoding="latin-1")
    return str(path)


@pytest.fixture(scope="module")
def net(spark, case):
    return models.load(spark, case)


def test_registry():
    assert len(REGISTRY["transformer"].fields) == 114 and len(REGISTRY["acline"].fields) == 34 and len(REGISTRY["twotermdc"].fields) == 48
    assert section("nothing").fields == [] and REGISTRY["bus"].id_cols == ("ibus",)
    assert expand("a:i (b#:d c#:s)[1-2] d:t") == [("a", "i"), ("b1", "d"), ("c1", "s"), ("b2", "d"), ("c2", "s"), ("d", "t")]
    own = register_section("own", REGISTRY["zone"].schema, ["izone"])
    assert section("own") is own
    del REGISTRY["own"]


def test_raw(net):
    assert net["caseid"].first().asDict() == {"ic": 0, "sbase": 100.0, "rev": 34, "xfrrat": 0, "nxfrat": 1, "basfrq": 60.0, "title1": "FIRST TITLE", "title2": "SECOND TITLE"}
    assert net["solver"].first()["method"] == "FDNS" and net["rating"].first()["desc"] == "First, with comma"
    assert [r["name"] for r in net["bus"].orderBy("ibus").collect()] == ["ONE", "TWO, B", "THREE", "FOUR"]
    two, three = net["transformer"].orderBy("kbus").collect()
    assert (two["windv2"], two["windv3"], two["wdg1rate1"], two["node1"], two["nmet"]) == (1.0, None, 700.0, 5, 2)
    assert (three["kbus"], three["wdg3rate1"], three["r2_3"]) == (4, 500.0, 0.03)
    assert net["impcor"].count() == 2 and net["ntermdcconv"].first()["nbrdg"] == 4 and net["ntermdclink"].first()["dcckt"] == "1"
    assert net["sub"].first()["name"] == "SUB_A" and net["subnode"].first()["ibus"] == 1 and net["subswd"].first()["isub"] == 1


@pytest.mark.parametrize("change", [("@!IC", "@!XX"), ("PSS(R)E-34", "PSS(R)E-35"), ("GENERAL,", "GENERIC,")])
def test_raw_refuses_others(change):
    with pytest.raises(raw.RawError):
        raw.parse(CASE.replace(*change, 1))


def test_split_line():
    assert raw.split_line(' 1, "A, B" ,\'C \', ') == ["1", "A, B", "C", ""]


def test_rawx_round_trip(spark, net, tmp_path):
    rawx.write({n: net[n] for n in ("bus", "acline")}, str(tmp_path / "m.rawx"))
    again = models.load(spark, str(tmp_path / "m.rawx"))
    assert sorted(again["bus"].collect()) == sorted(net["bus"].collect())
    with pytest.raises(ValueError):
        rawx.parse({"network": {"bus": {"data": []}}})
    assert rawx.clean('[12., 3.]') == "[12.0, 3.0]"
    case = models.load(spark, '{"general": {"version": "0.1", "n": [1, 2]}, "network": {"zone": {"fields": ["izone", "zoname"], "data": [[1, "a\x07b"]]}}}')
    assert case.general["n"] == [1, 2] and case["zone"].first()["zoname"] == "a\x07b"
    escaped = spark.createDataFrame([("a\x07b\x7f 1.,",)], "t string").select(scalar.clean_json(F.col("t"))).first()[0]
    assert escaped == "a\\u0007b\\u007f 1.0,"


def test_cache(spark, case, tmp_path):
    one = models.load_cached(spark, case, str(tmp_path))
    two = models.load_cached(spark, case, str(tmp_path))
    assert sorted(one.sections) == sorted(two.sections) and two["bus"].count() == 4


def test_enrichment(net):
    names = {r["ckt"]: r["derived_name"] for r in net.with_bus("acline").collect()}
    assert names["1"] == "ONE 500kV - TWO, B 34.5kV CKT 1"
    assert net.with_bus("load").first()["derived_name"] == "TWO, B 34.5kV - 1"
    assert {r["derived_name"] for r in net.with_bus("transformer").collect()} == {"ONE 500kV - THREE 230kV CKT T1", "ONE 500kV - THREE 230kV - FOUR 230kV CKT T2"}
    with pytest.raises(ValueError):
        net.with_bus("impcor")


def test_filters(net):
    assert {r["ibus"] for r in net.filter_by_area([2])["bus"].collect()} == {2}
    assert net.filter_by_area([2])["acline"].count() == 1 and net.filter_by_area({3: "x"})["transformer"].count() == 1
    assert {r["ibus"] for r in net.filter_by_kv(34.5, 230)["bus"].collect()} == {2}
    for bad in (lambda: net.filter_by_area([]), lambda: net.filter_by_kv(5, 5), lambda: net.filter_by_kv(-1), lambda: net.filter_section("bus", "area >"), lambda: net.filter_section("none", "a > 1"), lambda: net.filter_by_area([1], "other")):
        with pytest.raises(ValueError):
            bad()


def test_ties_and_hops(spark, net):
    assert [(r["ibus"], r["jbus"]) for r in net.tie_lines([1]).collect()] == [(1, 2)]
    assert net.tie_lines([1], kv_min=100).count() == 0
    seeds = spark.createDataFrame([(2,), (99,)], "ibus long")
    found = {r["ibus"]: r["hop"] for r in net.within_hops(seeds, 2).collect()}
    assert found == {2: 0, 1: 1, 3: 2, 4: 2}
    assert net.within_hops(seeds, 0).count() == 1
    assert set(net.neighborhood(seeds, 1, "dict")) == set(net.sections)
    assert net.tie_line_neighborhood(1, [1], "external")["bus"].count() == 2
    assert net.tie_line_neighborhood(1, [1], "external", kv_min=900)["bus"].count() == 0
    with pytest.raises(ValueError):
        net.neighborhood(seeds, 1, "other")
    assert topology.shortest_hops(net.hop_edges(), 2, 4, 5) == 2 and topology.shortest_hops(net.hop_edges(), 2, 4, 1) is None
    assert topology.shortest_path(net.hop_edges(), 2, 4) == [2, 1, 4] and topology.shortest_path(net.hop_edges(), 2, 99) is None
    lone = spark.createDataFrame([(7, "monitor", 99, None)], "flowgate_id long, role string, ibus long, jbus long")
    bus = net["bus"].select("ibus").union(spark.createDataFrame([(99,)], "ibus long"))
    assert [r["ibus"] for r in flowgate.neighborhoods(lone, bus, net["acline"], None, 2).collect()] == [99]


def test_graph_modes(net):
    triangle, built = net.edges("triangle"), net.edges("as_built")
    assert triangle.where("section = 'transformer'").count() == 4 and built.where("section = 'transformer'").count() == 5
    assert net.nodes().where("kind = 'load'").count() == 1
    with pytest.raises(ValueError):
        net.edges("none")


def test_comparison(spark, net):
    bus2 = net["bus"].where("ibus <> 4").withColumn("ibus", F.when(F.col("ibus") == 2, 22).otherwise(F.col("ibus"))).union(spark.createDataFrame([net["bus"].where("ibus = 4").first()], net["bus"].schema).withColumns({"ibus": F.lit(9).cast("long"), "name": F.lit("MID")}))
    line2 = spark.createDataFrame([(1, 9, "1"), (9, 3, "1")], "ibus long, jbus long, ckt string")
    two = Network({"bus": bus2, "acline": line2})
    one = Network({"bus": net["bus"], "acline": net["acline"].select("ibus", "jbus", "ckt")})
    c = Comparison(one, two)
    assert [(r["ibus_model1"], r["ibus_model2"]) for r in c.renumbered().collect()] == [(2, 22)]
    assert {r["presence"]: r["n"] for r in c.tables()["bus"].groupBy("presence").agg(F.count("*").alias("n")).collect()} == {"both": 2, "model1_only": 2, "model2_only": 2}
    graph = c.graph()
    assert [r["path"] for r in graph["path_sectionalizations"].collect()] == [["bus:1", "bus:9", "bus:3"]]
    assert graph["path_bypasses"].count() == 0
    named = graph["path_sectionalizations"].first()
    assert named["path_named"].count(" -> ") == 2 and named["original_path_named"].startswith("ONE (1) [500 kV, ide=1] - THREE (3)")
    keyless = Comparison(Network({"bus": net["bus"], "solver": net["solver"]}), Network({"bus": net["bus"], "solver": net["solver"].withColumn("actaps", F.lit(1).cast("long"))})).tables()["solver"]
    assert (keyless.first()["presence"], keyless.first()["actaps_delta"], keyless.first()["method_delta"]) == ("both", 1, False)
    with pytest.raises(AssertionError):
        c.renumbered(["ibus"])
    with pytest.raises(ValueError):
        c.renumbered(["nothing"])


def test_diff_nulls(spark):
    a = spark.createDataFrame([(1, None, 1.0), (2, "x", None)], "k int, s string, v double")
    b = spark.createDataFrame([(1, None, 3.0), (3, "y", 1.0)], "k int, s string, v double")
    out = {r["k"]: r for r in diff_section(a, b, ["k"]).collect()}
    assert (out[1]["s_delta"], out[1]["v_delta"], out[1]["presence"]) == (False, 2.0, "both")
    assert (out[2]["presence"], out[3]["presence"], out[3]["s_delta"]) == ("model1_only", "model2_only", True)


def test_reorder():
    assert reorder(["ibus_model1", "x", "ibus_name_model1", "path", "path_named"]) == ["ibus_model1", "ibus_name_model1", "x", "path", "path_named"]


MON = """BUSNAMES
MONITOR FLOWGATE 7  'a gate'
   BRANCH FROM BUS 'ONE         500.00' TO BUS 'TWO, B      34.500' CKT 1
 CONTINGENCY 7
   OPEN BRANCH FROM BUS 'ONE         500.00' TO BUS 'NONE        500.00' CKT 1
   REMOVE MACHINE 1 FROM BUS 'ONE         500.00'
 END
   CA X
   SC SCA
END
"""


def test_flowgates(spark, net, tmp_path):
    (tmp_path / "f.mon").write_text(MON)
    elements = mon.read(spark, str(tmp_path / "f.mon"))
    assert [r["sc"] for r in elements.collect()] == ["SCA"] * 3
    found = flowgate.key_facilities(elements, net, sc="SCA", hops=1)
    assert {r["reason"] for r in found["unresolved"].collect()} == {"bus_not_found", "generator_not_found"}
    assert {(r["equipment_type"], r["ckt_id"]) for r in found["branches"].collect()} == {("line", "1"), ("line", "2"), ("transformer_2w", "T1")}
    assert found["transformers_3w"].first()["transformer_name"] == "THREE WINDINGS" and found["generators"].count() == 0


@pytest.mark.parametrize("text", [MON.replace("\nEND\n", "\n"), MON.replace(" CONTINGENCY 7\n", "MONITOR FLOWGATE 8 'x'\n"), MON.replace("500.00' TO", "5' TO", 1), "END\n", "CONTINGENCY 1\n"])
def test_mon_refuses(text):
    with pytest.raises(ValueError):
        mon.parse(text)


def test_contingencies(spark, net, tmp_path):
    (tmp_path / "a.con").write_text("CONTINGENCY A\nOPEN BRANCH FROM BUS 2 TO BUS 1 CKT '1'\nEND\nCONTINGENCY B\nOPEN BRANCH FROM BUS 1 TO BUS 99 CKT 1\nREMOVE LOAD 1 FROM BUS 2\nEND\nCONTINGENCY C\nOPEN TRANSFORMER FROM BUS 4 TO BUS 1 TO BUS 3 CKT T2\nEND\n")
    cons = files.read_contingencies(spark, str(tmp_path / "a.con")).select(F.col("position").alias("con_id"), "text")
    known = contingency.known_references(net["bus"], net["acline"], net["transformer"], spark.createDataFrame([], REGISTRY["generator"].schema), net["load"])
    out = {r["con_id"]: r for r in contingency.info(cons, net["bus"], None, known).collect()}
    assert list(out[0]["undefined_branches"]) == [] and list(out[1]["undefined_buses"]) == ["99"] and list(out[1]["loads"]) == ["2/1"]
    assert list(out[2]["transformers"]) == ["4/1/3/T2"] and list(out[2]["undefined_transformers"]) == []
    assert (out[0]["lowest_voltage"], out[0]["highest_voltage"]) == (34.5, 500.0)


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "x int, s string")
    n = lambda t: df.where(to_column(t, df.columns)).count()
    assert n("x > 1") == 1 and n("x != 1") == 2 and n("not (x == 1)") == 2 and n("s in ['a', 'b'] and x < 5") == 1
    assert n("(x > 0) & ~(s == 'a') | x.isna()") == 2 and n("1 <= x <= 2") == 2 and n("x * 2 == 4") == 1 and n("s not in ['a']") == 2
    for bad in ("x >", "y == 1", "foo(x)", "x ** 2 == 4"):
        with pytest.raises(ValueError):
            to_column(bad, df.columns)


def test_scalars(spark):
    df = spark.createDataFrame([(500.0, "1", "1.5", "2020-01-01 00:00:00", "a"), (34.5, "2.0", None, None, None), (None, None, "x", None, "b")], "kv double, i string, f string, t string, s string")
    assert [r[0] for r in df.select(scalar.format_kv(F.col("kv"))).collect()] == ["500kV", "34.5kV", ""]
    assert dict(scalar.coerce(df).dtypes) == {"kv": "double", "i": "bigint", "f": "string", "t": "timestamp", "s": "string"}
    assert scalar.move_left(df, ["s", "none"]).columns[0] == "s" and scalar.move_right(df, ["kv"]).columns[-1] == "kv"
    assert scalar.validate_column(df, "kv", nullable=False, low=100, high=400, isin=[500.0], dtype="int").count(";") == 4
    assert scalar.validate_column(df, "s", pattern="^[ab]$") == "" and "match" in scalar.validate_column(df, "f", pattern="^x$")


def test_ragged_and_listing(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,2\n3\n4,5,6\n")
    assert files.read_ragged(spark, str(tmp_path / "r.csv"), ["a"]).columns == ["a", "Col1", "Col2"]
    (tmp_path / "q.csv").write_text('A,B\nx,y\n1,"a, ""b"""\n2\n')
    quoted = files.read_ragged(spark, str(tmp_path / "q.csv"), header_rows=2)
    assert quoted.columns == ["A x", "B y"] and {tuple(r) for r in quoted.collect()} == {("1", 'a, "b"'), ("2", None)}
    (tmp_path / "b.raw").write_text("x")
    (tmp_path / "a.rawx").write_text("x")
    assert [p[-6:] for p in files.model_files(str(tmp_path))] == ["a.rawx", "/b.raw"]
    assert files.newest(spark, str(tmp_path)).endswith("b.raw")
    with pytest.raises(FileNotFoundError):
        files.model_files(str(tmp_path / "none"))


def test_sinks(spark, net, tmp_path):
    sinks.network_csv(net, str(tmp_path / "net"))
    assert spark.read.option("header", True).csv(str(tmp_path / "net/network_bus")).count() == 4
    c = Comparison(net, net)
    sinks.comparison_csv({"bus": c.tables()["bus"]}, c.graph(), str(tmp_path / "cmp"))
    assert spark.read.option("header", True).csv(str(tmp_path / "cmp/network_bus")).where("presence = 'both'").count() == 4


def test_inch(spark):
    rows = spark.createDataFrame([(5, "1")], "ibus long, loadid string")
    assert inch.action(rows, "DELETE_LOAD").first()["record"] == "#DELETE_LOAD [BusNum,LoadID]\n5,1\n#END"
    assert len(inch.ACTIONS) == 34 and len(inch.ACTIONS["ADD_TRANSFORMER"][2]) == 104 and inch.ACTIONS["MODIFY_BUS_NUMBER"][2] == {"BusNum": "ibus", "BusNumChn": "new_ibus"}
    diff = diff_section(spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "izone long, zoname string"), spark.createDataFrame([(1, "A"), (2, "X"), (4, "D")], "izone long, zoname string"), ["izone"])
    assert {r["record"] for r in inch.from_diff(diff, "ZONE").collect()} == {"#DELETE_ZONE [ZoneNum]\n3\n#END", "#ADD_ZONE [ZoneNum,ZoneName]\n4,D\n#END", "#MODIFY_ZONE [ZoneNum,ZoneName]\n2,X\n#END"}
    with pytest.raises(ValueError):
        inch.action(rows, "NONE")

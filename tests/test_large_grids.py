"""Cases that only larger grids have: numbers used twice, many flowgates, case files of several splits."""

from gridloom.operators.compare import Comparison
from gridloom.operators.network import Network


def test_query_keeps_rows_of_a_number_used_twice_as_they_are(spark):
    kind = "ibus long, name string, baskv double, area int, vm double"
    one = spark.createDataFrame([(1, "A", 230.0, 1, 1.0)], kind)
    two = spark.createDataFrame([(1, "A", 230.0, 1, 2.0), (1, "B", 345.0, 1, 3.0)], kind)
    load = spark.createDataFrame([(1, "1")], "ibus long, loadid string")
    found = Comparison(Network({"bus": one, "load": load}), Network({"bus": two, "load": load})).query({"bus": "vm_delta > 0"})
    assert sorted(r["name_model2"] for r in found["bus"].collect()) == ["A", "B"]


def test_many_walkers_at_once_reach_what_each_reaches_alone(spark):
    from pyspark.sql import functions as F

    from gridloom.operators import topology

    n = 300  # more walkers than a packed row holds, some of them without a role
    pairs = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(n + 1).select(F.col("id").alias("node"))
    seeds = nodes.select(F.col("node").alias("flow"), F.when(F.col("node") % 2 == 0, "even").alias("role"), "node")
    state, walkers = topology.packed_reach(pairs, seeds, 2, ["flow", "role"], nodes)
    assert walkers.select("block", "bit").distinct().count() == n + 1 and state.count() <= 4 * (n + 1)
    found = {(r["flow"], r["node"]) for r in topology.unpacked(state, walkers, ["flow", "role"]).collect()}
    assert found == {(f, m) for f in range(n) for m in range(max(0, f - 2), min(n, f + 3))} | {(n, n)}


def test_raw_case_of_many_splits_gives_the_rows_of_the_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridloom.sources import models, raw
    from tests.test_grid import CASE

    at = CASE.index("0 / END OF BUS DATA")
    more = CASE[:at] + "".join(f"  {n},'BUS {n},'' ',230.0,1,1,1,1,1.0,0.0,1.1,0.9,1.1,0.9\n" for n in range(5, 60)) + "\n" + CASE[at:]
    (tmp_path / "a b.raw").write_text(more, "latin-1")
    (tmp_path / "c.raw").write_text(CASE.replace("ONE ", "\xd6NE "), "latin-1")
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = models.read_long(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len({r["task"] for r in rows if r["path"].endswith("/a b.raw") and r["section"] == "bus"}) > 1
    for name, text in (("a b.raw", more), ("c.raw", CASE.replace("ONE ", "\xd6NE "))):
        own = sorted((r["section"], r["rec"], sorted(r["fields"].items())) for r in rows if r["path"].endswith("/" + name))
        assert [(s, f) for s, _, f in own] == [(s, sorted(f.items())) for s, _, f in sorted(raw.parse(text), key=lambda r: r[:2])]


def test_raw_refuses_files_that_are_no_case(spark, tmp_path):
    import pytest

    from gridloom.sources import models

    for n, text in enumerate(("x\n", "x\n" * 9)):
        (tmp_path / f"{n}.raw").write_text(text)
        with pytest.raises(Exception, match="not those of a case"):
            models.read_long(spark, str(tmp_path / f"{n}.raw")).collect()


def test_packed_walk_sends_a_row_a_node_not_an_edge(spark):
    from pyspark.sql import functions as F

    from gridloom.operators import topology

    n, wide = 400, 20
    sent = lambda: sum(s.shuffleWriteRecords() for s in stages(spark))
    pairs = spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + wide)).alias("b")).where(f"b < {n}")
    nodes = spark.range(n).select(F.col("id").alias("node"))
    seeds = nodes.select(F.col("node").alias("flow"), F.lit("x").alias("role"), "node")
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {c: spark.conf.get(c) for c in (*conf, "spark.sql.requireAllClusterKeysForCoPartition")}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        before = sent()
        state, walkers = topology.packed_reach(pairs, seeds, 4, ["flow", "role"], nodes)
        state.count()
        assert sent() - before < 100_000
        found = {(r["flow"], r["node"]) for r in topology.unpacked(state, walkers, ["flow", "role"]).collect()}
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == old.pop("spark.sql.requireAllClusterKeysForCoPartition")
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert found == {(f, m) for f in range(n) for m in range(max(0, f - 4 * wide), min(n, f + 4 * wide + 1))}


def stages(spark):
    """The finished stages of the session."""
    jvm = spark._jvm
    found = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [found.apply(k) for k in range(found.size())]

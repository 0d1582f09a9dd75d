"""Nodes, edges, hops and bounded paths, as DataFrames."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.registry import ONE_BUS, TWO_BUS, section
from gridloom.storage import release, stored

_EDGE = ("src", "dst", "section", "id")
LAZY_HOPS = 6
WORDS = 16  # longs of a packed row; each holds 64 walkers
REGION = 13  # bits: a region has 2**13 node numbers at most


def bus_node(c: str):
    return F.concat(F.lit("bus:"), F.col(c).cast("string"))


def _key(name: str, cols: list[str]):
    return F.concat_ws(":", F.lit(name), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _end(a, b, ok):
    return F.struct(a.alias("a"), b.alias("b"), ok.alias("ok"))


def edges(network, mode: str = "triangle") -> DataFrame:
    """(src, dst, section, id). One-bus equipment hangs on its bus as a node of its own. Transformers: `triangle` joins their buses to
    each other, `as_built` gives each a node on which windings 1 and 2 hang, and another for winding 3. Parallel circuits are kept."""
    out = []
    for name in ONE_BUS:
        if name in network:
            ids = list(section(name).id_cols)
            out.append(network[name].select(bus_node(section(name).bus_cols[0]).alias("src"), _key(name, ids).alias("dst"), F.lit(name).alias("section"), _key(name, ids).alias("id")))
    for name in TWO_BUS:
        if name in network:
            a, b = section(name).bus_cols[:2]
            ids = [c for c in section(name).id_cols if c in network[name].columns]
            out.append(network[name].select(bus_node(a).alias("src"), bus_node(b).alias("dst"), F.lit(name).alias("section"), _key(name, ids).alias("id")))
    if "transformer" in network:
        t = network["transformer"]
        ident = _key("transformer", ["ibus", "jbus", "kbus", "ckt"])
        three = F.coalesce(F.col("kbus"), F.lit(0)) != 0
        if mode == "triangle":
            ends = F.array(_end(F.col("ibus"), F.col("jbus"), F.lit(True)), _end(F.col("jbus"), F.col("kbus"), three), _end(F.col("ibus"), F.col("kbus"), three))
            pairs = t.select(F.explode(ends).alias("e"), ident.alias("id")).where("e.ok")
            out.append(pairs.select(bus_node("e.a").alias("src"), bus_node("e.b").alias("dst"), F.lit("transformer").alias("section"), "id"))
        elif mode == "as_built":
            centre = F.when(three, ident).otherwise(_key("transformer", ["ibus", "jbus"]))
            ends = F.array(_end(bus_node("ibus"), centre, F.lit(True)), _end(bus_node("jbus"), centre, F.lit(True)), _end(bus_node("kbus"), _key("transformer", ["ibus", "jbus"]), three))
            pairs = t.select(F.explode(ends).alias("e"), ident.alias("id")).where("e.ok")
            out.append(pairs.select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"), F.lit("transformer").alias("section"), "id"))
        else:
            raise ValueError("mode must be triangle or as_built")
    return _union(out).select(*_EDGE)


def nodes(network) -> DataFrame:
    """(node, kind): buses and one-bus equipment."""
    out = [network["bus"].select(bus_node("ibus").alias("node"), F.lit("bus").alias("kind"))]
    out += [network[n].select(_key(n, list(section(n).id_cols)).alias("node"), F.lit(n).alias("kind")) for n in ONE_BUS if n in network]
    return _union(out).distinct()


def hop_edges(network) -> DataFrame:
    """(a, b): buses one hop apart, a < b, over lines, switches, DC links, multi-section lines and transformers."""
    out = []
    for name in TWO_BUS:
        if name in network:
            a, b = section(name).bus_cols[:2]
            out.append(network[name].select(F.col(a).alias("x"), F.col(b).alias("y")))
    if "transformer" in network:
        out += transformer_pairs(network["transformer"])
    return canonical(_union(out))


def flowgate_edges(network) -> DataFrame:
    """(a, b): as hop_edges, over lines and transformers only."""
    return canonical(_union([network["acline"].select(F.col("ibus").alias("x"), F.col("jbus").alias("y")), *(transformer_pairs(network["transformer"]) if "transformer" in network else [])]))


def transformer_pairs(t: DataFrame) -> list[DataFrame]:
    three = t.where(F.coalesce(F.col("kbus"), F.lit(0)) != 0)
    return [d.select(F.col(a).alias("x"), F.col(b).alias("y")) for d, a, b in ((t, "ibus", "jbus"), (three, "jbus", "kbus"), (three, "ibus", "kbus"))]


def canonical(pairs: DataFrame) -> DataFrame:
    return pairs.where("x is not null and y is not null and x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def hops(pairs: DataFrame, seeds: DataFrame, n: int, keys: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(keys..., node, hop): what each key's seeds reach within n edges of pairs (a, b). All keys walk in one job.

    A hop is one join and one aggregate: every node also has an edge to itself that costs nothing, so the state carries what was reached
    before, and the plan grows by one step a hop. Beyond LAZY_HOPS the state is written."""
    keys = keys or []
    all_nodes = nodes if nodes is not None else pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reach = _union([pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("w")), pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(1).alias("w")), all_nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("w"))])
    if n > 1:
        reach = stored(reach)
    state = seeds.select(*keys, "node").distinct().join(all_nodes, "node", "left_semi").withColumn("hop", F.lit(0))
    for k in range(n):
        state = state.join(reach, state["node"] == reach["src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.min(F.col("hop") + F.col("w")).alias("hop"))
        if (k + 1) % LAZY_HOPS == 0 and k + 1 < n:
            state = stored(state)
    return state.select(*keys, "node", "hop")


def _both_ways(pairs: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """(src, dst): pairs both ways, and each node to itself."""
    return _union([pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")), all_nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))])


@contextmanager
def placed_by_part(spark: SparkSession):
    """Joins of tables that are both dealt by some of the join's columns take them as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def packed_reach(pairs: DataFrame, seeds: DataFrame, n: int, keys: list[str], nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What hops gives without the hop, packed: (node, block, w0, w1, ...) and the walkers (block, bit, keys...). Bit b of a row is bit
    b % 64 of word b // 64: the key at that bit of the block reaches the node.

    Where most keys reach most nodes, a row for each of both at each edge is more than any join should make; here an edge passes
    64 * WORDS keys at once, by OR. Keys whose least seeds are near share a block, so blocks stay together in sparse graphs too.

    Nodes are dealt by region, a range of their numbers, since neighbours mostly have near ones: what a region sends to a node is one row,
    made where the region's edges are, and not one an edge. A hop has one shuffle; both sides of its join are dealt by region already.
    Of one hop only the plan is made; the session that runs it may deal its rows again."""
    size = 64 * WORDS
    own = stored(seeds.select(*keys, "node").distinct().join(nodes, "node", "left_semi"))
    # Numbers within partitions, since one over all keys would be a sort in one task. Written, since partitions may fall otherwise when made again.
    dealt = own.groupBy(*keys).agg(F.min("node").alias("_at")).repartitionByRange("_at", *keys).withColumn("_part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_at", *keys)) - 1
    walkers = stored(dealt.withColumn("_place", place).select(((F.col("_part").cast("long") * F.lit(1 << 32)) + F.floor(F.col("_place") / size)).alias("block"), (F.col("_place") % size).alias("bit"), *keys))
    word = lambda k: F.when(F.floor(F.col("bit") / 64) == k, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))
    joined = walkers.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    state = own.join(joined, [own[k].eqNullSafe(joined[f"_k_{k}"]) for k in keys]).groupBy("node", "block").agg(*[F.bit_or(word(k)).alias(f"w{k}") for k in range(WORDS)])
    region = lambda c: F.shiftright(F.col(c).cast("long"), REGION).alias("region")
    reach = _both_ways(pairs, nodes)
    reach = (stored(reach) if n > 1 else reach).select(region("src"), "src", "dst").repartition("region").withColumnRenamed("region", "_of")
    met = [F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)]
    dealt = lambda rows: rows.select(region("node"), *state.columns).repartition("region")
    for k in range(n):
        rows = dealt(state) if k % LAZY_HOPS == 0 else spread
        rows = rows.join(reach, (rows["region"] == reach["_of"]) & (rows["node"] == reach["src"]))
        sent = rows.groupBy("_of", F.col("dst").alias("node"), "block").agg(*met)
        spread = dealt(sent).groupBy("region", "node", "block").agg(*met)
        state = spread.drop("region")
        if (k + 1) % LAZY_HOPS == 0 and k + 1 < n:
            with placed_by_part(state.sparkSession):
                state = stored(state)
    # What the hops have sent goes before their result is spread over the keys.
    if n > 1:
        with placed_by_part(state.sparkSession):
            state = stored(state)
        release(state.sparkSession)
    return state, walkers


def unpacked(state: DataFrame, walkers: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each walker and row of the state that has its bit: the walker's keys, then the state's other columns. A packed row becomes
    many, so the state is dealt over all partitions, however small it is."""
    state = state.repartition(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    others = [c for c in state.columns if c != "block" and c not in {f"w{k}" for k in range(WORDS)}]
    lists = walkers.select("block", F.floor(F.col("bit") / 64).cast("int").alias("_word"), F.struct((F.col("bit") % 64).alias("_bit"), *keys).alias("_one")).groupBy("block", "_word").agg(F.collect_list("_one").alias("_all"))
    words = state.select(*others, "block", F.posexplode(F.array(*[F.col(f"w{k}") for k in range(WORDS)])).alias("_word", "_bits")).where("_bits <> 0")
    ones = words.join(lists, ["block", "_word"]).select(*others, "_bits", F.explode("_all").alias("_one"))
    return ones.where("(shiftright(_bits, _one._bit) & 1L) = 1L").select(*[F.col(f"_one.{k}").alias(k) for k in keys], *others)


def simple_paths(starts: DataFrame, pairs: DataFrame, inner: DataFrame, most: int, shortest: bool = False) -> DataFrame:
    """(a, b, path): simple paths of 2 to `most` edges from a to b whose inner nodes are all in inner[node]; with `shortest` a pair is
    searched no further once it has a path, so that all its paths are of the least length.

    Only edges with an inner node can be on such a path; the condition is put into each step, so the search never leaves them."""
    ok = inner.select("node").distinct()
    both = _union([pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))])
    mark = lambda c: ok.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_in"))
    both = stored(both.join(mark("src"), "src", "left").join(mark("dst"), "dst", "left").where("src_in or dst_in").select("src", "dst", F.coalesce("dst_in", F.lit(False)).alias("inside")))
    state = starts.select("a", "b", F.array("a").alias("path"), F.col("a").alias("last"))
    done: DataFrame | None = None
    for k in range(most):
        step = state.join(both, state["last"] == both["src"]).where(~F.array_contains("path", F.col("dst")) & ((F.col("dst") == F.col("b")) | F.col("inside")))
        step = stored(step.select("a", "b", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last")))
        if k:
            done = step.where("last = b") if done is None else done.unionByName(step.where("last = b"))
        state = step.where("last <> b")
        if shortest and k:
            state = state.join(step.where("last = b").select("a", "b").distinct(), ["a", "b"], "left_anti")
        if step.isEmpty():
            break
    return (done if done is not None else state.where("false")).select("a", "b", "path")


def shortest_path(pairs: DataFrame, source: int, target: int, most: int | None = None) -> list | None:
    """The nodes of a shortest path, both ends included; None if there is none (of `most` edges). Of equal ones that through the least
    nodes near the target. The search widens one edge at a time over written tables; only the path comes to the driver."""
    if source == target:
        return [source] if not pairs.where((F.col("a") == source) | (F.col("b") == source)).isEmpty() else None
    both = stored(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a")))
    kind = dict(both.dtypes)["src"]
    front = both.sparkSession.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(None).cast(kind).alias("before"))
    steps = [stored(front)]
    seen = steps[0].select("node")
    while most is None or len(steps) <= most:
        new = steps[-1].join(both, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("before")).join(seen, "node", "left_anti")
        new = stored(new)
        steps.append(new)
        if not new.where(F.col("node") == target).isEmpty():
            break
        if new.isEmpty():
            return None
        seen = seen.union(new.select("node"))
    else:
        return None
    path = [target]
    for step in reversed(steps[1:]):
        path.append(step.where(F.col("node") == path[-1]).first()["before"])
    return path[::-1]


def shortest_hops(pairs: DataFrame, source: int, target: int, most: int | None = None) -> int | None:
    """The number of edges between two nodes, None if there is no path (of `most` edges)."""
    path = shortest_path(pairs, source, target, most)
    return None if path is None else len(path) - 1

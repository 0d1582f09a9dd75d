"""Line dedup: like lines are found by joining on pigeonhole blocks of their words and verified by edit similarity; one occurrence of each
connected group stays. DataFrame operations only.

A line is normalised by lower-casing and reading every run of other characters than letters, marks and digits as a space. Equal
normalised lines are one group by their hash, if they have MIN_WORDS words or MIN_CHARS characters.
Lines of MIN_WORDS words at least are compared by edit similarity over words, 1 - edits / words of the longer line >= SIMILARITY.

1. Blocks. A line of n words has n blocks of three consecutive words (after the last word comes the first). An edit touches three
   blocks at most, so of a like line at most floor(0.6 n) blocks are missing: by the pigeonhole principle, if blocks are put into one
   global order (by a hash of their first words, then of all; those that start with a short word last), like lines share SHARED = 2 of the
   first floor(0.6 n) + 2 of each.
   These are the keys of a line, all of up to 20 words and the first KEYS of longer ones: at least 0.4 of a like line's blocks are
   common, so that fewer than two of the first 14 are has a chance of 0.8 % at the limit of similarity with edits spread evenly, and
   less with others.
2. Keys that only one line has, or only lines of unlike lengths, go before rows are joined; lines that share fewer than two of theirs with
   any others are done, and keys that only they had. A line that needs two leaves its most frequent key: a like line shares another. The
   least line of a key is its hub; all lines of keys with one hub are a region.
3. Each line of a region is compared with the hub; those that are unlike it are compared with all others of the region, unless links found
   before connect them. Of regions with over WIDE pairs, such lines first meet PIVOTS lines of the region, others in each round, until the
   like pairs that these find tell that no more are left than there are lines: a group of like lines is connected by then, so the pairs
   that the comparison with all finds do not grow with its square. 256 bits of each line's words rule out most pairs; the edits of the rest are those of two strings with one
   character a word. No pair is sent anywhere.
4. Regions with over HOT * HOT pairs to compare (a passage that many lines hold) are cut by a second pigeonhole: of n words at most
   floor(0.2 n) are missing in a like line, so like lines share one of the first floor(0.2 n) + 1 words of each in any one order; here,
   that of rising frequency among all lines of such regions. What is so large still is dealt over tasks, as cells of HOT by HOT lines.
5. Of a connected group the occurrence with the smallest (doc_id, line number) stays.

SimHash does not make the keys: at a similarity of 0.8 (an angle of acos 0.8) two sketches of 64 bits are expected to differ in 13 bits,
so blocks that pigeonhole leaves equal would have 3 to 4 bits. The pigeonhole join stays, over blocks of words.

Defined cases: null and empty texts stay as they are; a document that loses all its lines has an empty text; rows with a null doc_id
are left alone; repeated rows (equal doc_id and text) count as one occurrence, so they keep the same lines; an empty table gives an
empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import NEAR, SHINGLE, forget, written
from gridloom.llm.graph import components

MIN_WORDS = SHINGLE
SIMILARITY = NEAR
MIN_CHARS = 6
BLOCK = 3
KEYS, SHARED = 14, 2
SHORT = 3
HOT = 4_096
#: Regions of over WIDE pairs meet so many of their lines a round before all.
WIDE, PIVOTS = 1 << 14, 16
#: How many numbers of 64 bits mark a line's words, by the first two bits of the words' hashes.
SKETCH = 4
#: What stands between words: of ASCII all but letters, digits and the end of a line, one by one, since such a class is one table; then others.
#: They are one class, so that a text is read once, and only characters beyond ASCII are looked up.
SPACES = "[" + "".join(f"\\x{c:02x}" for c in range(128) if c not in (10, 32) and not chr(c).isalnum()) + r"[\x{80}-\x{10FFFF}&&[^\p{L}\p{M}\p{N}]]]"
#: Regions of up to so many lines are compared many at a time.
SMALL, PAIRS = 128, 1 << 16


def _words(norm: str) -> Column:
    return F.array_remove(F.split(norm, " "), "")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, line, norm, h (a hash for each word; those of short words are not negative, so they stand last): the lines of all texts."""
    text = F.regexp_replace(F.lower("text"), f"{SPACES}++ *+", " ")
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = own.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(text, "\n")).alias("line", "norm"))
    word = lambda w: F.when(F.length(w) > SHORT, F.xxhash64(w).bitwiseOR(F.lit(-1 << 63))).otherwise(F.shiftrightunsigned(F.xxhash64(w), 1))
    return lines.select("doc_id", "th", "line", "norm", F.array_remove(F.transform(F.split("norm", " "), word), word(F.lit(""))).alias("h"))


def _measured(docs: DataFrame, similarity: float, min_words: int) -> DataFrame:
    """doc_id, th, line, lh (hash of the words, of lines that count), n (words), need, keys, norm (the text, of lines that are compared)."""
    # A filter on words would reckon them twice, so lines that do not count stay, without lh.
    n = F.size("h")
    enough = n >= min_words
    counts = enough | (F.length(F.replace("norm", F.lit(" "), F.lit(""))) >= MIN_CHARS)
    lost = F.floor(n * (BLOCK * (1 - similarity)) + 1e-9).cast("int")
    lines = _lines(docs).select("doc_id", "th", "line", F.when(enough, F.col("norm")).alias("norm"), n.alias("n"), F.when(counts, F.xxhash64("h")).alias("lh"), lost.alias("lost"), F.when(enough, F.col("h")).alias("h"))
    # The order of blocks is that of 16 bits of their first words, then of 32 bits of all of their words. So words tell which blocks can be
    # among the first: no others are hashed.
    wanted = F.least(F.lit(KEYS), F.col("lost") + SHARED, F.col("n"))
    last = F.get(F.sort_array("h"), wanted - 1).bitwiseOR(F.lit((1 << 48) - 1))
    lines = lines.select("*", wanted.alias("wanted"), last.alias("last"), F.concat("h", F.slice("h", 1, BLOCK - 1)).alias("around"))
    # 48 bits are written and sent smaller; blocks that share a hash are told apart by the edits.
    whole = lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get("around", i + k) for k in range(1, BLOCK)]), 32)
    block = lambda x, i: F.call_function("shiftleft", F.shiftright(x, 48) + (1 << 15), F.lit(32)).bitwiseOR(whole(x, i))
    blocks = F.transform("h", lambda x, i: F.when(x <= F.col("last"), block(x, i)).otherwise(F.lit((1 << 63) - 1)))
    keys = F.when(F.col("h").isNotNull(), F.array_distinct(F.slice(F.sort_array(blocks), F.lit(1), F.col("wanted")))).otherwise(F.array().cast("array<long>"))
    lines = lines.select("doc_id", "th", "line", "lh", "n", "lost", "norm", keys.alias("keys"))
    # A line of few distinct blocks may share one only.
    sure = (F.size("keys") >= KEYS) | (F.size("keys") - F.col("lost") >= SHARED)
    return lines.select("doc_id", "th", "line", "lh", "n", F.when(sure, SHARED).otherwise(1).alias("need"), "keys", "norm")


def _codes(lines: DataFrame) -> DataFrame:
    """lh, n, code (a character of four bytes for each word, 26 of its bits from the word's hash), s0 ... (a bit for each word)."""
    lines = lines.select("lh", F.transform(_words("norm"), lambda w: F.xxhash64(w)).alias("h"))
    letters = F.array_join(F.transform("h", lambda h: F.hex(h.bitwiseAND(F.lit(0x03FFFFFF)).bitwiseOR(F.lit(0xF0000000)))), "")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(63)).cast("int"))
    # A sketch's own words stand together in the order of hashes, between marks: no word is tested for each sketch.
    marks = [F.lit(k << 62).cast("long") for k in range(1 - SKETCH // 2, SKETCH // 2)]
    lines = lines.select("lh", F.size("h").alias("n"), F.unhex(letters).alias("code"), F.sort_array(F.concat("h", F.array(*marks))).alias("h"))
    at = [F.array_position("h", m).cast("int").alias(f"p{k + 1}") for k, m in enumerate(marks)]
    lines = lines.select("*", F.lit(0).alias("p0"), *at, (F.size("h") + 1).alias(f"p{SKETCH}"))
    own = lambda k: F.slice("h", F.col(f"p{k}") + 1, F.col(f"p{k + 1}") - F.col(f"p{k}") - 1)
    sketch = [F.aggregate(own(k), F.lit(0).cast("long"), lambda x, h: x.bitwiseOR(bit(h))).alias(f"s{k}") for k in range(SKETCH)]
    return lines.select("lh", "n", "code", *sketch)


def _like(a: str, b: str, similarity: float) -> Column:
    """Whether two lines are like: by their lengths, by words that only one has, and by the edits."""
    of = lambda t: lambda c: F.col(f"{t}.{c}")
    x, y = of(a), of(b)
    most = F.greatest(x("n"), y("n"))
    edits = F.floor(most * (1 - similarity) + 1e-9).cast("int")

    def fits(x, y):
        """So few words of x can be none of y's."""
        lost = [F.bit_count(x(f"s{k}").bitwiseAND(F.bitwise_not(y(f"s{k}")))) for k in range(SKETCH)]
        return reduce(add, lost) <= x("n") - most + edits

    return fits(x, y) & fits(y, x) & (F.call_function("levenshtein", x("code").cast("string"), y("code").cast("string"), edits) >= 0)


def _star(regions: DataFrame, codes: DataFrame, similarity: float) -> DataFrame:
    """region, lh, like: whether a line is like the hub of its region, which has the region's name."""
    hubs = codes.select(F.col("lh").alias("region"), *[F.col(c) for c in codes.columns if c != "lh"])
    rows = regions.where("lh <> region").join(codes.hint("shuffle_hash"), "lh").alias("x").join(hubs.hint("shuffle_hash").alias("hub"), F.col("x.region") == F.col("hub.region"))
    return written(rows.select("x.region", "x.lh", _like("x", "hub", similarity).alias("like")), "star")


def _parts(star: DataFrame) -> DataFrame:
    """region, rest (lines unlike the hub), n, of regions where such lines must meet others."""
    return star.groupBy("region").agg(F.count_if(~F.col("like")).alias("rest"), F.count(F.lit(1)).alias("n")).where("rest > 0 and n > 1")


def _others(star: DataFrame, parts: DataFrame, codes: DataFrame, names: DataFrame, similarity: float) -> DataFrame:
    """a, b: links of lines unlike their hub with the others of the region, unless names (node, root) tells that they have met; by their roots.
    Large regions are dealt over tasks, as cells of a square. No pair is sent: only those that are like leave the join."""
    named = names.select(F.col("node").alias("lh"), F.col("root").alias("name"))
    cells = parts.select("region", F.ceil(F.col("rest") / HOT).cast("int").alias("p"), F.ceil(F.col("n") / HOT).cast("int").alias("q"))
    rows = star.join(cells, "region").join(named, "lh", "left").withColumn("name", F.coalesce("name", "lh")).join(codes.hint("shuffle_hash"), "lh")
    rows = written(rows, "rows", repeats=False)
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c, seed: F.pmod(F.xxhash64("lh", F.lit(seed)), F.col(c)).cast("int")
    one = rows.where("not like").withColumn("u", dealt("p", 0)).withColumn("v", each("q")).alias("x")
    other = rows.withColumn("v", dealt("q", 1)).withColumn("u", each("p")).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("region", "u", "v")]
    once = (F.col("x.name") != F.col("y.name")) & (F.col("y.like") | (F.col("x.lh") < F.col("y.lh")))
    found = one.join(other.hint("merge"), same[0] & same[1] & same[2] & once & _like("x", "y", similarity))
    found = written(found.select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct(), "alike")
    forget(rows)
    return found


def _pivoted(star: DataFrame, parts: DataFrame, codes: DataFrame, names: DataFrame, similarity: float) -> DataFrame:
    """The names after lines unlike their hub have met lines of their region that a hash picks, in rounds."""
    wide = parts.where(f"rest * n > {WIDE}")
    if wide.isEmpty():
        return names
    rows = written(star.join(wide.select("region", F.col("n").alias("lines")), "region").join(codes.hint("shuffle_hash"), "lh"), "wide", repeats=False)
    unlike, seed = rows.where("not like").count(), 0
    while True:
        named = rows.join(names.select(F.col("node").alias("lh"), F.col("root").alias("name")), "lh", "left").withColumn("name", F.coalesce("name", "lh"))
        picked = named.where(F.pmod(F.xxhash64("lh", F.lit(seed)), F.col("lines")) < PIVOTS)
        once = (F.col("x.region") == F.col("y.region")) & (F.col("x.name") != F.col("y.name"))
        found = named.where("not like").alias("x").join(picked.alias("y"), once & _like("x", "y", similarity))
        found = written(found.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), (F.col("x.lines") / PIVOTS).alias("stands_for")), "pivoted")
        # Of lines / PIVOTS lines one was picked: so many like pairs of different names may have been there.
        there = found.agg(F.sum("stands_for")).first()[0] or 0
        if there:
            names = _met(names, found.select("a", "b"))
        forget(found)
        if there <= unlike:
            forget(rows)
            return names
        seed += 1


def _leads(regions: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """region, lh: the lines of large regions in smaller ones, by their first words, rare ones among all of these lines first."""
    words = lines.join(regions.select("lh").distinct(), "lh", "left_semi").select("lh", _words("norm").alias("words"))
    words = words.select("lh", F.size("words").alias("n"), F.explode(F.array_distinct("words")).alias("w")).select("lh", "n", F.xxhash64("w").alias("word"))
    words = written(words, "words")
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    line = Window.partitionBy("lh").orderBy("often", "word")
    lead = words.join(often, "word").withColumn("k", F.row_number().over(line)).where(F.col("k") <= F.floor(F.col("n") * (1 - similarity) + 1e-9) + 1)
    cut = written(regions.join(lead.select("lh", "word"), "lh"), "cut")
    hubs = cut.groupBy("region", "word").agg(F.min("lh").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("region", "word", "hub")
    out = written(cut.join(hubs, ["region", "word"]).select(F.col("hub").alias("region"), "lh").distinct(), "leads")
    forget(words, cut)
    return out


def _shared(members: DataFrame, similarity: float, most: bool = False) -> DataFrame:
    """The rows of keys that several lines of like lengths have, and of lines that have enough such keys. With most, lines that need two are
    left without their most frequent key: like lines share two, so still one; keys have one order, by how many lines have them."""
    # If a line of the key has a like length, the next longer or the next shorter one has.
    key = Window.partitionBy("key").orderBy("n")
    short, long = F.lag("n").over(key), F.lead("n").over(key)
    left = members.select("lh", "need", "n", "key", short.alias("short"), long.alias("long"), *[F.count(F.lit(1)).over(Window.partitionBy("key")).alias("often")] * most)
    left = left.where((F.col("short") >= F.col("n") * similarity - 1e-9) | (F.col("n") >= F.col("long") * similarity - 1e-9)).drop("short", "long")
    line = Window.partitionBy("lh")
    left = left.withColumn("k", F.count(F.lit(1)).over(line))
    if most:
        left = left.withColumn("last", F.max(F.struct("often", "key")).over(line))
        left = left.where((F.col("need") < SHARED) | (F.struct("often", "key") != F.col("last")))
    return written(left.where("k >= need").select("lh", "need", "n", "key"), "members")


def _regions(found: DataFrame, similarity: float) -> DataFrame:
    """region, lh: lines with a hub, the least line that has one of their keys."""
    keyed = found.where(F.size("keys") > 0).select("lh", F.when(F.col("need") < SHARED, -F.col("n")).otherwise(F.col("n")).alias("n"), F.explode("keys").alias("key"))
    # Dealt once: keys are counted where their rows are, and those that lines share find them there. Both sides use all columns, or the
    # rows would be sent twice.
    keyed = keyed.repartition("key")
    # Lines that are equal have one hash, so a key that only they have has one.
    shared = keyed.groupBy("key").agg(F.min("lh").alias("least"), F.max("lh").alias("most"), F.max(F.abs("n")).alias("n")).where("least < most and n > 0").select("key")
    need = F.when(F.col("n") < 0, 1).otherwise(SHARED)
    # Equal lines become one where their keys are, and lengths are compared there: what is dealt again is one row a line and key.
    few = keyed.join(shared.hint("shuffle_hash"), "key").distinct().select("lh", need.alias("need"), F.abs("n").alias("n"), "key")
    first = _shared(few, similarity)
    members = _shared(first, similarity, most=True)
    forget(first)
    hubs = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("lh").alias("region")).where("n > 1").select("key", "region")
    regions = written(members.join(hubs.hint("shuffle_hash"), "key").select("region", "lh").distinct(), "regions")
    forget(members)
    return regions


def _met(names: DataFrame, links: DataFrame) -> DataFrame:
    """The names (node, root) after links of roots, or of lines that had no name."""
    more = components(links)
    moved = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    own = names.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(own.unionByName(more.join(names, "node", "left_anti")), "names")


def _links(regions: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """node, root: the components of like lines."""
    codes = written(_codes(lines), "codes", repeats=False)
    linked = lambda star: star.where("like").select(F.col("region").alias("a"), F.col("lh").alias("b"))
    star = _star(regions, codes, similarity)
    names = components(linked(star))
    parts = written(_parts(star), "parts")
    large = f"rest * n > {HOT} * {HOT}"
    few = parts.where(f"not ({large})")
    names = _pivoted(star, few, codes, names, similarity)
    names = _met(names, _others(star, few, codes, names, similarity))
    hot = parts.where(large).select("region")
    if not hot.isEmpty():
        star = _star(_leads(regions.join(hot, "region"), lines, similarity), codes, similarity)
        own = names.select("node", "root")
        rooted = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c)).alias(c)
        ends = linked(star)
        for c in "ab":
            ends = ends.join(own.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
        names = _met(names, ends.select(rooted("a"), rooted("b")).where("a <> b"))
        parts = written(_parts(star), "parts")
        names = _pivoted(star, parts, codes, names, similarity)
        names = _met(names, _others(star, parts, codes, names, similarity))
    forget(codes)
    return names


def dropped_lines(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, drop (line numbers): what goes, for each document that loses lines."""
    # The largest table that is written: its words repeat, its values do not.
    found = written(_measured(docs, similarity, min_words), "lines", "zstd", repeats=False)
    regions = _regions(found, similarity)
    wanted = regions.select("lh").distinct()
    lines = written(found.where("norm is not null").select("lh", "norm").join(wanted.hint("shuffle_hash"), "lh", "left_semi").dropDuplicates(["lh"]), "wanted", "zstd", repeats=False)
    roots = _links(regions, lines, similarity)
    forget(regions, lines)
    # Equal lines, and like ones, have one name. Of what was written first, only places of lines are read.
    named = found.where("lh is not null").select("doc_id", "th", "line", "lh").join(roots.withColumnRenamed("node", "lh").hint("shuffle_hash"), "lh", "left")
    named = written(named.select("doc_id", "th", "line", F.coalesce("root", "lh").alias("name")), "named", repeats=False)
    forget(found)
    # Names are dealt once and put in order; repeated rows have one rank.
    gone = named.withColumn("rank", F.rank().over(Window.partitionBy("name").orderBy("doc_id", "line", "th"))).where("rank > 1")
    gone = written(gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("drop")), "gone")
    forget(named)
    return gone


def _left(docs: DataFrame, similarity: float, min_words: int) -> DataFrame:
    """row (all columns), drop, left (the lines that stay, of texts that lose some)."""
    gone = dropped_lines(docs, similarity, min_words)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    rows = rows.join(gone.hint("shuffle_hash"), ["doc_id", "th"], "left").select("row", "drop", F.when(F.col("drop").isNotNull(), F.split("row.text", "\n")).alias("parts"))
    return rows.select("row", "drop", F.when(F.col("drop").isNotNull(), F.filter("parts", lambda x, i: ~F.array_contains("drop", i))).alias("left"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, n_dropped: a row for each document."""
    rows = _left(docs, similarity, min_words)
    # Lines of a text that stays whole are only counted.
    n = F.length("row.text") - F.length(F.replace("row.text", F.lit("\n"), F.lit(""))) + 1
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    text = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))
    return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), count(n).alias("n_lines"), count(F.when(F.col("drop").isNotNull(), n - F.size("left"))).alias("n_dropped"), text.alias("text"))


def drop_repeated(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the lines that stay, all columns of theirs; those that lost every line go. n_chars, if there, is kept true."""
    rows = _left(docs, similarity, min_words).where("drop is null or size(left) > 0")
    changed = {"text": F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("drop").isNull(), F.col("row.n_chars")).otherwise(F.length(changed["text"])).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


# The same links reckoned in numpy, in one place: the operator does not use this; tests compare both with all pairs.


def edits(a: list[int], b: list[int]) -> int:
    """The edit distance; a bit for each word of a in whole numbers of any length."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top, more, less, found = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for x in b:
        same = places.get(x, 0)
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up, off = less | (full & ~(across | more)), more & across
        found += 1 if up & top else -1 if off & top else 0
        up, off = (up << 1 | 1) & full, (off << 1) & full
        more, less = off | (full & ~(down | up)), up & down
    return found


def _pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within runs of these sizes."""
    after = np.repeat(np.cumsum(size), size) - np.arange(size.sum()) - 1
    one = np.repeat(np.arange(len(after)), after)
    return one, one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(after) - after, after)


def _within(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first + 0, first + 1 ... of each run of n, where each run starts)"""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), ends - n


class Forest:
    def __init__(self, labels: np.ndarray):
        self.top = list(range(int(labels.max(initial=-1)) + 1))

    def find(self, x: int) -> int:
        top = self.top
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x


def all_links(region: np.ndarray, names: np.ndarray, roots: np.ndarray, every: np.ndarray, n: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect all like lines of each region, beside those that stand in roots. Rows are in the order of region; every has the
    words of all rows, n of each."""
    first = np.cumsum(n) - n
    bit = np.uint64(1) << (every & np.uint32(63)).astype(np.uint64)
    half = (every & np.uint32(64)).astype(bool)
    sketch = [np.bitwise_or.reduceat(np.where(half == bool(k), bit, np.uint64(0)), first) for k in range(2)]
    label = np.unique(roots, return_inverse=True)[1]
    names, forest = names.tolist(), Forest(label)
    own, lines = label.tolist(), {}
    # A word of a row as one number, by rank.
    word = np.unique(every, return_inverse=True)[1]
    held = np.unique(np.repeat(np.arange(len(n)), n) * (word.max() + 1) + word)
    lost = lambda i, j: sum(np.bitwise_count(s[i] & ~s[j]).astype(np.int64) for s in sketch)
    out = []

    def join(i: int, j: int, a: int, b: int, now: np.ndarray | None) -> None:
        forest.top[b] = a
        if now is not None:
            now[now == b] = a
        out.append((min(names[i], names[j]), max(names[i], names[j])))

    def compare(i: np.ndarray, j: np.ndarray, now: np.ndarray | None = None) -> None:
        least = np.maximum(n[i], n[j]) * similarity - 1e-9
        ok = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= least)
        i, j, least = i[ok], j[ok], least[ok]
        ok = (lost(i, j) <= n[i] - least) & (lost(j, i) <= n[j] - least)
        i, j, least = i[ok], j[ok], least[ok]
        if not len(i):
            return
        # Words that differ place by place, from the start or the end, are no fewer than the edits.
        both, gap = np.minimum(n[i], n[j]), np.abs(n[i] - n[j])
        alike = np.zeros(len(i), bool)
        for end in (0, 1):
            x, at = _within(first[i] + end * (n[i] - both), both)
            y, _ = _within(first[j] + end * (n[j] - both), both)
            alike |= np.add.reduceat((every[x] != every[y]).astype(np.int64), at) + gap <= np.maximum(n[i], n[j]) - least
        for x, y in zip(i[alike].tolist(), j[alike].tolist()):
            if (a := forest.find(own[x])) != (b := forest.find(own[y])):
                join(x, y, a, b, now)
        i, j, least = i[~alike], j[~alike], least[~alike]
        if not len(i):
            return
        # Words that only the other line has are edits; bits of long lines do not tell that.
        x, at = _within(first[j], n[j])
        wanted = np.repeat(i, n[j]) * (word.max() + 1) + word[x]
        there = held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted
        ok = np.add.reduceat(there.astype(np.int64), at) >= least
        for x, y in zip(i[ok].tolist(), j[ok].tolist()):
            if (a := forest.find(own[x])) == (b := forest.find(own[y])):
                continue
            one, other = (lines[k] if k in lines else lines.setdefault(k, every[first[k] : first[k] + n[k]].tolist()) for k in (x, y))
            if edits(one, other) <= max(len(one), len(other)) * (1 - similarity) + 1e-9:
                join(x, y, a, b, now)

    starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]])) if len(region) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([starts, [len(region)]]))
    few = np.flatnonzero((size > 1) & (size <= SMALL))
    # So many pairs of rows are held at once; a longer line has more words to compare.
    for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(size[few] ** 2) // PAIRS)) + 1):
        if len(part):
            rows, _ = _within(starts[part], size[part])
            i, j = _pairs(size[part])
            compare(rows[i], rows[j])
    for lo, hi in zip(starts[size > SMALL].tolist(), (starts + size)[size > SMALL].tolist()):
        now = label[lo:hi]
        now[:] = [forest.find(x) for x in own[lo:hi]]
        for i in range(lo, hi - 1):
            j = i + 1 + np.flatnonzero(now[i - lo + 1 :] != now[i - lo])
            compare(np.full(len(j), i), j, now)
    return out


def region_links(names: np.ndarray, roots: np.ndarray, code: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all like lines of a region, beside those that stand in roots."""
    return all_links(np.zeros(len(names), np.int64), names, roots, np.concatenate(code), np.array([len(x) for x in code], np.int64), similarity)

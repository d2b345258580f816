"""Near-duplicate classes by min-max hashing, with links confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm import words
from tarnwatch.llm.joins import sized
from tarnwatch.operators.graph import connected
from tarnwatch.scratch import Scratch

#: Signature values in a band.
BAND = 4
#: How often at most a pair at the threshold may share no band; the number of bands follows from it.
MISS = 1e-5
#: Sets, and shingles of sets together, that are compared with each other at once.
BLOCK, BLOCK_SHINGLES = 400, 1 << 20


def bands_for(percent: int) -> int:
    """Bands of four values such that a pair at the threshold shares none once in 100,000 times: 16 at 85, 22 at 80."""
    missed = 1 - (percent / 100) ** BAND
    return max(1, math.ceil(math.log(MISS) / math.log(missed))) if missed > 0 else 1


def shingle_sets(column: pa.Array, size: int, separators: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its shingles); a text of fewer words is one shingle, one without words has none."""
    values, inside = words.byte_values(separators, fold_case=True)
    for first, n, data, offsets in words.parts(column):
        starts, ends, text = words.word_spans(data, offsets, inside)
        hashes = words.word_hashes(data, starts, ends, values)
        shingles = words.shingle_hashes(hashes, size)
        at = np.searchsorted(text, np.arange(n + 1))
        for i in range(n):
            a, b = at[i], at[i + 1]
            if b - a >= size:
                yield first + i, np.unique(shingles[a : b - size + 1])
            else:
                yield first + i, words.shingle_hashes(hashes[a:b], max(1, int(b - a)))


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """Minimum and maximum under each permutation, spread by a last mixing step."""
    factors = words.mixed(np.arange(101, 101 + hashes, dtype=np.uint64)) | np.uint64(1)
    h = shingles[None, :] * factors[:, None]
    return words.mixed(np.concatenate([h.min(axis=1), h.max(axis=1)]))


def _sign(size: int, separators: bytes, bands: int):
    weights = words.mixed(np.arange(7, 7 + BAND, dtype=np.uint64)) | np.uint64(1)
    names = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = -(-bands * BAND // 2)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            count, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            keys: list = [None] * n
            for i, s in shingle_sets(batch.column("text"), size, separators):
                count[i] = len(s)
                if len(s):
                    m = words.mixed(s)
                    low[i], high[i] = m.sum(dtype=np.uint64).view(np.int64), np.bitwise_xor.reduce(words.mixed(m)).view(np.int64)
                    values = signature(s, hashes)[: bands * BAND].reshape(-1, BAND)
                    keys[i] = words.mixed((values * weights).sum(axis=1, dtype=np.uint64) + names).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(count), pa.array(low), pa.array(high), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "row", "n", "low", "high", "bands"],
            )

    return run


def _collect_sets(size: int, separators: bytes):
    def run(batches):
        for batch in batches:
            sets = [b""] * batch.num_rows
            for i, s in shingle_sets(batch.column("text"), size, separators):
                sets[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint64)


def _similar(n: int, m: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def _both(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _links(pairs: list) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _against_hub(percent: int):
    """Rows come sorted by hub and part, the hub's own set first; confirmed links to it."""

    def run(batches):
        hub = None
        for batch in batches:
            found = []
            nodes, hubs, sets = batch.column("node").to_pylist(), batch.column("hub").to_pylist(), batch.column("shingles")
            for i, (node, name) in enumerate(zip(nodes, hubs, strict=True)):
                own = _set(sets[i])
                if node == name:
                    hub = own.copy()
                elif _similar(len(own), len(hub), _both(own, hub), percent):
                    found.append((node, name))
            yield _links(found)

    return run


def _linked_in(nodes: list, labels: list, sets: list, asks: np.ndarray, home: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows that ask and rows at home, none within a class that is already linked.

    One sorted index over all sets gives a row's intersections with all others at once.
    """
    up: dict = {x: x for x in labels}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found, right = [], np.flatnonzero(home)
    for i in np.flatnonzero(asks):
        own = root(labels[i])
        if all(root(labels[j]) == own for j in right):
            continue
        begin, end = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        counts = end - begin
        where = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(owner[where], minlength=len(sets))
        for j in right[100 * both[right] >= percent * (sizes[right] + sizes[i] - both[right])]:
            if root(labels[j]) != root(labels[i]):
                up[root(labels[j])] = root(labels[i])
                found.append((nodes[i], nodes[j]))
    return found


def _in_blocks(percent: int):
    """Rows come sorted by band, block and part; links within each run of them."""

    def run(batches):
        key, held = None, []

        def linked():
            nodes, labels, asks, home, sets = zip(*held, strict=True)
            return _linked_in(nodes, labels, sets, np.array(asks), np.array(home), percent)

        for batch in batches:
            found, sets = [], batch.column("shingles")
            columns = [batch.column(c).to_pylist() for c in ("band", "block", "part", "node", "label", "asks", "home")]
            for i, (band, block, part, node, label, asks, home) in enumerate(zip(*columns, strict=True)):
                if (band, block, part) != key:
                    if held:
                        found += linked()
                    key, held = (band, block, part), []
                held.append((node, label, asks, home, _set(sets[i]).copy()))
            yield _links(found)
        if held:
            yield _links(linked())

    return run


def near_duplicates(
    df: DataFrame,
    *,
    shingle: int = 3,
    percent: int = 85,
    separators: bytes = words.SPACES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Classes of documents whose shingle sets are similar, linked directly or through others.

    1. Each text becomes its set of word shingles (A-Z as a-z) and a min-max
       signature; documents with equal sets are one candidate. The number of
       bands follows from the threshold (``bands_for``).
    2. Of the candidates in a bucket (one band's value) the smallest is its hub.
       Each candidate is compared, on whole sets, with the hub that shares most
       bands with it, in parts of 400. So a large group of copies hangs on its
       hub and is never expanded into pairs.
    3. A bucket is done if its members have one label by then. In every other
       one (one of those with the same members), rows that do not have its most
       frequent label are compared with all its rows, block by block, by an
       index of whole sets. No pair of a bucket that could join two classes is
       left out; a pair that shares no bucket is never looked at.
    4. Confirmed links are joined into classes once.

    Links are between sets, each named by a 64-bit hash of its first id and
    text, so ids may be null or repeat with other texts: such rows are
    documents of their own.

    Returns one row for each input row: _id, _row (the text's hash), n_shingles,
    component_id (the smallest id reachable), kept. Of a class the row with the
    smallest id is kept, and of equal ids that with the smallest _row; a null
    id is larger than all others. A null or wordless text has no shingles and
    is linked with nothing; rows that repeat are one class, all kept or none.
    Long texts are taken whole (a set of up to 8 bytes a word is held in
    memory); an empty table gives no rows. Extra columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "near")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).alias("text"))
    signed = scratch.cut(texts.mapInArrow(_sign(shingle, separators, bands_for(percent)), "id long, row long, n long, low long, high long, bands array<long>"), "signed")
    own = F.struct(F.col("id").isNull().alias("last"), "id", "row", "bands")
    classes = signed.where("n > 0").groupBy("low", "high", "n").agg(F.min(own).alias("first"), F.count("*").alias("rows"))
    classes = scratch.cut(classes.withColumn("node", F.xxhash64("first.id", "first.row")), "classes")

    banded = classes.select("node", "n", F.explode("first.bands").alias("band"))
    buckets = scratch.cut(banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1").select("band", "hub"), "buckets")
    members = scratch.cut(banded.join(sized(buckets), "band"), "members")
    wanted = scratch.cut(members.select("node").distinct(), "wanted")
    node = F.xxhash64("id", "row")
    sets = texts.select(node.alias("node"), "text").join(sized(wanted), "node").mapInArrow(_collect_sets(shingle, separators), "node long, shingles binary")
    sets, (n_sets,) = scratch.replace(sets, "sets")
    if n_sets > wanted.count():  # rows repeat
        sets = scratch.cut(sets.dropDuplicates(["node"]), "sets")

    links = scratch.cut(_links_to_hubs(members, sets, percent, scratch), "links")
    parents = sized(links.select(F.col("a").alias("node"), F.col("b").alias("up")))
    labels = scratch.cut(links.select(F.col("a").alias("child"), F.col("b").alias("node")).join(parents, "node", "left").select(F.col("child").alias("node"), F.coalesce("up", "node").alias("label")), "labels")
    links = links.union(_links_in_buckets(members.join(sized(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), sets, percent, scratch))

    roots = scratch.cut(connected(links, scratch), "roots")
    linked = classes.join(sized(roots), "node", "left").withColumn("first", F.struct("first.last", "first.id", "first.row"))
    linked = scratch.cut(linked.where("root is not null or rows > 1").select("low", "high", "n", "first", "root"), "linked")
    leaders = sized(scratch.cut(linked.where("root is not null").groupBy("root").agg(F.min("first").alias("leader")), "leaders"))
    found = linked.join(leaders, "root", "left").select("low", "high", "n", F.coalesce("leader", "first").alias("leader"))
    found = scratch.cut(found.select("low", "high", "n", F.col("leader.id").alias("leader_id"), F.col("leader.row").alias("leader_row")), "found")
    rows = signed.select("id", "row", "n", "low", "high")
    joined = rows.where("n > 0").join(sized(found), ["low", "high", "n"], "left")  # a class that is not there is one row, its own leader
    alone = F.col("leader_row").isNull()
    joined = joined.select(
        "id", "row", "n", F.when(alone, F.col("id")).otherwise(F.col("leader_id")).alias("component_id"), (alone | (F.col("id").eqNullSafe(F.col("leader_id")) & (F.col("row") == F.col("leader_row")))).alias("kept")
    )
    wordless = rows.where("n = 0").select("id", "row", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return joined.union(wordless).select(F.col("id").alias("_id"), F.col("row").alias("_row"), F.col("n").alias("n_shingles"), "component_id", "kept")


def _links_to_hubs(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Each node against the hub with which it shares most bands, of equal ones the smallest."""
    shared = members.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("shared"))
    best = F.max(F.struct("shared", F.bitwise_not("hub").alias("not_hub")))
    spokes = scratch.cut(shared.groupBy("node").agg(best.alias("best")).select("node", F.bitwise_not("best.not_hub").alias("hub")), "spokes")
    hubs = spokes.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    hubs = scratch.cut(hubs.select(F.col("hub").alias("node"), F.col("hub"), "parts"), "hubs")
    parts = sized(hubs.select("hub", "parts"))
    dealt = spokes.join(parts, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    dealt = scratch.cut(dealt, "dealt")
    rows = sets.join(sized(dealt), "node").select("hub", "part", "node", "shingles")
    centres = sets.join(sized(hubs), "node").select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "shingles")
    rows = rows.union(centres).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node") != F.col("hub"))
    return rows.select("node", "hub", "shingles").mapInArrow(_against_hub(percent), "a long, b long")


def _links_in_buckets(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between rows of a bucket that have different labels."""
    marks = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    mixed = members.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), F.sum("n").alias("total"), *marks).where("low < high")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.groupBy("m", "total", "x", "y").agg(F.min("band").alias("band")).select("band", blocks.alias("blocks"))
    mixed = scratch.cut(mixed, "mixed")
    if mixed.isEmpty():
        return scratch.spark.createDataFrame([], "a long, b long")
    rows = scratch.cut(members.join(sized(mixed), "band").select("band", "node", "label", "n", "blocks"), "in-mixed")
    by_label = rows.groupBy("band", "label").agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    cores = by_label.groupBy("band").agg(F.max(F.struct("c", "label", "total")).alias("core"), F.sum("c").alias("m"), F.sum("total").alias("total"))
    outside = F.greatest((F.col("m") - F.col("core.c")) / BLOCK, (F.col("total") - F.col("core.total")) / BLOCK_SHINGLES)
    cores = scratch.cut(cores.select("band", F.col("core.label").alias("core"), F.ceil(outside).cast("int").alias("parts")), "cores")
    rows = rows.join(sized(cores), "band").withColumns({"block": F.pmod(F.xxhash64("node"), "blocks").cast("int"), "own": F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int"), "outside": F.col("label") != F.col("core")})
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda block, part, asks, home: F.struct(block.alias("block"), part.alias("part"), asks.alias("asks"), home.alias("home"))
    asking = F.transform(upto("blocks"), lambda b: place(b, F.col("own"), F.lit(True), b == F.col("block")))
    at_home = F.transform(F.filter(upto("parts"), lambda p: ~F.col("outside") | (p != F.col("own"))), lambda p: place(F.col("block"), p, F.lit(False), F.lit(True)))
    places = F.concat(F.when(F.col("outside"), asking).otherwise(F.slice(asking, 1, 0)), at_home)
    dealt = rows.select("band", "node", "label", F.explode(places).alias("to")).select("band", "node", "label", "to.*")
    dealt = dealt.join(sets, "node").repartition("band", "block", "part").sortWithinPartitions("band", "block", "part", "node")
    return scratch.cut(dealt.mapInArrow(_in_blocks(percent), "a long, b long"), "links")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    # two rows of one id may both be its component's; ``kept_row`` tells which of them stays
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("kept").alias("kept_row"))

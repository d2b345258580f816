"""Benchmark decontamination by a prefix-filtered join of word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm import words
from tarnwatch.scratch import Scratch

#: Words of a window, and words of the shingles by which windows are found.
WINDOW, SHINGLE = 10, 3
#: Bits of the filter that tasks get: half a megabyte, however large the benchmark is.
FILTER_BITS = 22
_MASK = np.uint64((1 << FILTER_BITS) - 1)
_VALUES, _INSIDE = words.byte_values(words.NOT_ALNUM, fold_case=True)
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _item_windows(batches):
    """Each distinct window of an item with its shingles: hash and offset."""
    for batch in batches:
        out = []
        items = batch.column("item").to_pylist()
        for first, n, data, offsets in words.parts(batch.column("text")):
            starts, ends, text = words.word_spans(data, offsets, _INSIDE)
            hashes = words.word_hashes(data, starts, ends, _VALUES)
            raw = data.tobytes().translate(_FOLD)
            for i in range(n):
                a, b = np.searchsorted(text, [i, i + 1])
                size = min(WINDOW, int(b - a))
                if not size:
                    continue
                part = min(SHINGLE, size)
                shingles = words.shingle_hashes(hashes[a:b], part).view(np.int64)
                for k in range(int(b - a) - size + 1):
                    window = b" ".join(raw[starts[j] : ends[j]] for j in range(a + k, a + k + size)).decode()
                    out += [(items[first + i], window, size, part, int(shingles[k + o]), o) for o in range(size - part + 1)]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item", "window", "size", "part", "shingle", "offset"])


def _filter_of(shingles: DataFrame) -> bytes:
    """Two bits for each hash. At most 2^22 distinct bits reach the driver."""
    low, high = F.col("shingle").bitwiseAND(int(_MASK)), F.shiftrightunsigned("shingle", FILTER_BITS).bitwiseAND(int(_MASK))
    bits = shingles.select(F.explode(F.array(low, high)).alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)
    found = np.zeros(1 << FILTER_BITS, dtype=bool)
    found[bits] = True
    return np.packbits(found).tobytes()


class _Finder:
    """Positions in texts whose shingle may be one of those in the filter."""

    def __init__(self, packed: bytes, parts: list[int]):
        self.bits, self.parts = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool), parts

    def positions(self, hashes: np.ndarray, text: np.ndarray):
        for part in self.parts:
            shingles = words.shingle_hashes(hashes, part)
            hit = self.bits[shingles & _MASK]
            at = np.flatnonzero(hit)
            at = at[self.bits[(shingles[at] >> np.uint64(FILTER_BITS)) & _MASK]]
            at = at[text[at] == text[at + part - 1]] if len(at) else at
            yield part, at, shingles[at].view(np.int64)


def _document_counts(packed: bytes, sizes: list[int]):
    def run(batches):
        finder = _Finder(packed, sizes)
        for batch in batches:
            found = []
            for _, _, data, offsets in words.parts(batch.column("text")):
                starts, ends, text = words.word_spans(data, offsets, _INSIDE)
                for _, at, shingles in finder.positions(words.word_hashes(data, starts, ends, _VALUES), text):
                    order = np.lexsort((text[at], shingles))
                    s, t = shingles[order], text[at][order]
                    new = np.ones(len(s), bool)
                    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
                    found.append(s[new])
            hashes, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts.astype(np.int64))], names=["shingle", "docs"])

    return run


def _find(packed: bytes, sizes: list[int]):
    """Per document: its words, and for each likely prefix shingle its position and the words around it."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("shingle", pa.int64()), ("first", pa.int32()), ("around", pa.list_(pa.string()))]))

    def run(batches):
        finder = _Finder(packed, sizes)
        for batch in batches:
            counts, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for first, n, data, offsets in words.parts(batch.column("text")):
                starts, ends, text = words.word_spans(data, offsets, _INSIDE)
                counts[first : first + n] = np.bincount(text, minlength=n)[:n]
                begins = np.searchsorted(text, np.arange(n + 1))
                raw = None
                for part, at, shingles in finder.positions(words.word_hashes(data, starts, ends, _VALUES), text):
                    for p, s in zip(at.tolist(), shingles.tolist(), strict=True):
                        raw = data.tobytes().translate(_FOLD) if raw is None else raw
                        t = text[p]
                        a, b = max(p - WINDOW + 1, begins[t]), min(p + part + WINDOW - 1, begins[t + 1])
                        around = [raw[starts[j] : ends[j]].decode() for j in range(a, b)]
                        found[first + t].append({"at": int(p - begins[t]), "shingle": s, "first": int(a - begins[t]), "around": around})
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(counts), pa.array(found, kind)], names=["id", "row", "n_words", "found"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Words of documents that stand in a window of a benchmark item.

    A window is 10 consecutive words of an item, or a shorter item as a whole.
    A window occurs only where its rarest shingle does (rarity: in how many
    documents a shingle occurs, over all documents), so that one shingle of
    each window is its prefix. Documents give out the positions that pass a
    filter of the prefixes, of a fixed size; these are joined to the windows on
    the shingle, kept where the window fits between the text's ends, and
    confirmed word by word.

    Returns one row for each document: _id, _row (hash of the text), n_words,
    n_hit, items (sorted ids, as strings). Null and wordless texts have no
    words; items without words have no windows; repeated rows get equal
    results; an empty benchmark leaves all documents clean.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("row", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    windows = scratch.cut(items.mapInArrow(_item_windows, "item string, window string, size int, part int, shingle long, offset int"), "windows")
    sizes = sorted(r[0] for r in windows.select("part").distinct().collect())  # 1 to 3

    counts = texts.select("text").mapInArrow(_document_counts(_filter_of(windows), sizes), "shingle long, docs long")
    counts = counts.groupBy("shingle").agg(F.sum("docs").alias("docs"))
    shingles = windows.select("window", "size", "part", "shingle", "offset").distinct()
    rarest = Window.partitionBy("window").orderBy(F.coalesce("docs", F.lit(0)), "shingle", "offset")
    prefixes = shingles.join(counts, "shingle", "left").withColumn("_k", F.row_number().over(rarest)).where("_k = 1")
    prefixes = scratch.cut(prefixes.select("window", "size", "shingle", "offset"), "prefixes")

    found = texts.mapInArrow(
        _find(_filter_of(prefixes), sizes), f"id {texts.schema['id'].dataType.simpleString()}, row long, n_words long, found array<struct<at:int,shingle:long,first:int,around:array<string>>>"
    )
    found = scratch.cut(found, "found")
    at = found.where(F.size("found") > 0).select("id", "row", "n_words", F.explode("found").alias("f")).select("id", "row", "n_words", "f.*")
    start = F.col("at") - F.col("offset")
    fits = (start >= F.col("first")) & (start + F.col("size") <= F.col("n_words")) & (start - F.col("first") + F.col("size") <= F.size("around"))
    hits = at.join(prefixes, "shingle").where(fits)
    hits = hits.where(F.array_join(F.slice("around", start - F.col("first") + 1, F.col("size")), " ") == F.col("window"))
    hits = scratch.cut(hits.select("id", "row", "window", "size", start.alias("start")).distinct(), "hits")

    # words covered by windows that overlap: each start adds what lies beyond the furthest end so far
    spans = F.array_sort(F.collect_list(F.struct("start", "size")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["size"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    n_hit = hits.groupBy("id", "row").agg(spans.alias("spans")).select("id", "row", covered.alias("n_hit"))
    owners = windows.select("window", "item").distinct()
    named = hits.select("id", "row", "window").distinct().join(owners, "window").groupBy("id", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = n_hit.join(named, (n_hit["row"] == named["row"]) & n_hit["id"].eqNullSafe(named["id"])).select(n_hit["id"].alias("i"), n_hit["row"].alias("r"), "n_hit", "items")
    every = found.select("id", "row", "n_words").join(both, (F.col("row") == F.col("r")) & F.col("id").eqNullSafe(F.col("i")), "left")
    return every.select(
        F.col("id").alias("_id"), F.col("row").alias("_row"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k + 1 : k + n], ' ') AS t
  FROM (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0))
), grams AS (
  SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, n, k FROM grams JOIN win USING (n, t)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

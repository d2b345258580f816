"""Phrases whose words come together more often than apart, by SETM relational mining.

SETM keeps, for each length, the relation of all occurrences that may still
count: (piece, position, group). The relation of the next length is the
merge-join of the last one with itself by piece and adjacent position, its
groups are counted, and occurrences are semi-joined with the frequent groups
before they are extended again.

Here a record of a relation holds the occurrences of one document as two sorted
arrays, position and group; a position is skipped where a piece ends, so
neighbours in position are neighbours within a piece. A record is never split
over tasks, so the merge-join needs no shuffle; only counts are shuffled. The
relations are written, so a lost executor costs a part of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwatch.llm import joins, words
from tarnwatch.scratch import Scratch

#: Ends of pieces, and the blanks between words of a piece.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"
_RELATION = "pos array<int>, gram array<long>"


def _word_table(langs: pa.Array, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(first row, row of each word, position, word) of runs of rows; A-Z are lower-cased."""
    folded = np.arange(256, dtype=np.uint8)
    folded[65:91] += 32
    inside = np.ones(256, dtype=bool)
    inside[list(PIECE_ENDS + BLANKS)] = False
    ends_piece = np.zeros(256, dtype=bool)
    ends_piece[list(PIECE_ENDS)] = True
    for first, _, data, offsets in words.parts(texts, 1 << 21):
        starts, ends, row = words.word_spans(data, offsets, inside)
        n = len(starts)
        if not n:
            continue
        gaps = np.concatenate([[0], np.cumsum(ends_piece[data], dtype=np.int64)])[starts]
        number = np.arange(n, dtype=np.int64)
        new_piece = np.concatenate([[False], (gaps[1:] > gaps[:-1]) & (row[1:] == row[:-1])])
        first_word = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        skipped = np.cumsum(new_piece)
        pos = number + skipped
        pos -= np.repeat(pos[first_word], np.diff(np.append(first_word, n)))
        kept = np.zeros(len(data) + 1, dtype=np.int8)
        kept[starts] += 1
        kept[ends] -= 1
        letters = folded[data[np.cumsum(kept[:-1], dtype=np.int8).astype(bool)]]
        limits = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        yield first, row, pos, pa.LargeStringArray.from_buffers(n, pa.py_buffer(limits), pa.py_buffer(letters))


def _column(batch: pa.RecordBatch, i: int, null: str) -> pa.Array:
    return pc.fill_null(batch.column(i).cast(pa.large_string()), null)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = _column(batch, 0, "und")
        for first, row, _, word in _word_table(langs, batch.column(1)):
            table = pa.table({"lang": langs.take(pa.array(first + row)), "word": word})
            found = table.group_by(["lang", "word"], use_threads=False).aggregate([([], "count_all")])
            found = found.sort_by([("lang", "ascending"), ("word", "ascending")])  # like rows side by side are shuffled in less space
            yield from found.rename_columns(["lang", "word", "n"]).cast(_COUNTS).combine_chunks().to_batches()


_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
#: Different pairs that a task adds up before it sends them (24 bytes each, and as much again while sorting).
PAIRS_HELD = 2_000_000


def _record_batch(row: np.ndarray, pos: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
    """One record for each row that has occurrences; row and position are sorted."""
    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    limits = pa.array(np.append(heads, len(row)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(limits, pa.array(v)) for v in (pos.astype(np.int32), gram.astype(np.int64))]
    return pa.RecordBatch.from_arrays(lists, ["pos", "gram"])


def _neighbours(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of a relation with itself by record and adjacent position: (row, position, left group, right group)."""
    pos, gram = batch.column(0), batch.column(1)
    limits = np.asarray(pos.offsets)
    at, group = np.asarray(pos.flatten()), np.asarray(gram.flatten())
    row = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
    meets = np.flatnonzero((at[1:] == at[:-1] + 1) & (row[1:] == row[:-1]))
    return row[meets], at[meets], group[meets], group[meets + 1]


def _slices(batches: Iterator[pa.RecordBatch], records: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, records):
            yield batch.slice(at, records)


def _counted_pairs(left: list[np.ndarray], right: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs in order, with their counts added up."""
    a, b, k = np.concatenate(left), np.concatenate(right), np.concatenate(n)
    order = np.lexsort((b, a))
    a, b, k = a[order], b[order], k[order]
    heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    return a[heads], b[heads], np.add.reduceat(k, heads) if len(heads) else k


def _pair_counts(relation: DataFrame) -> DataFrame:
    """(left, right, a) of all pairs of neighbours.

    A task adds up its pairs, some million at a time, and sends them sorted in
    arrays, one for each of many buckets of pairs: like numbers side by side
    take half the space of a row for each pair. A bucket is a hash of both
    sides, so no common word is a hot key, and counts need no second shuffle.
    """
    buckets = max(64, 4 * int(relation.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def packed(left: list, right: list, n: list) -> pa.RecordBatch:
        a, b, k = _counted_pairs(left, right, n)
        bucket = (words.mixed(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        limits = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(limits), pa.array(v[order])) for v in (a, b, k)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), *lists], ["bucket", "left", "right", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, n, held = [], [], [], 0
        for batch in _slices(batches):
            _, _, a, b = _neighbours(batch)
            a, b, k = _counted_pairs([a], [b], [np.ones(len(a), dtype=np.int64)])
            left, right, n, held = [*left, a], [*right, b], [*n, k], held + len(a)
            if held >= PAIRS_HELD:
                yield packed(left, right, n)
                left, right, n, held = [], [], [], 0
        if held:
            yield packed(left, right, n)

    sent = relation.mapInArrow(counted, "bucket int, left array<long>, right array<long>, n array<long>").where(F.size("left") > 0).repartition("bucket")
    pairs = sent.select("bucket", F.explode(F.arrays_zip("left", "right", "n")).alias("p")).select("bucket", "p.left", "p.right", "p.n")
    return pairs.groupBy("bucket", "left", "right").agg(F.sum("n").alias("a")).drop("bucket")


def _numbered(groups: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """A written table with ``gram``, numbers from 0 without gaps: place in the part plus the sizes of the parts before it."""
    placed = scratch.cut(groups.withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))  # one short row for each part of the table
    numbered = placed.withColumn("_part", part).join(sizes, "_part")
    gram = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return scratch.cut(numbered.withColumn("gram", gram).drop("_place", "_part", "_before"), name)


def _small(groups: DataFrame) -> bool:
    """Whether the keys of the groups may be sent to every task."""
    return groups.count() * 64 <= joins.MOST_BYTES


def _first_relation(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """Occurrences of frequent words."""
    spark = docs.sparkSession
    if _small(frequent):
        known: dict = {}
        for lang, word, gram in zip(*[c.to_pylist() for c in frequent.select("lang", "word", "gram").toArrow().columns], strict=True):
            known.setdefault(lang, ([], []))[0].append(word)
            known[lang][1].append(gram)
        sent = spark.sparkContext.broadcast({k: (pa.array(w, pa.large_string()), np.array(g, dtype=np.int64)) for k, (w, g) in known.items()})

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = _column(batch, 0, "und")
                for first, row, pos, word in _word_table(langs, batch.column(1)):
                    kinds = langs.slice(first, int(row[-1]) + 1).dictionary_encode()
                    kind = np.asarray(kinds.indices)[row]
                    gram = np.full(len(row), -1, dtype=np.int64)
                    for k, lang in enumerate(kinds.dictionary.to_pylist()):
                        mine = np.flatnonzero(kind == k)
                        if lang in sent.value and len(mine):
                            value_set, grams = sent.value[lang]
                            found = np.asarray(pc.fill_null(pc.index_in(word.take(pa.array(mine)), value_set), -1))
                            gram[mine[found >= 0]] = grams[found[found >= 0]]
                    has = gram >= 0
                    yield _record_batch(row[has], pos[has], gram[has])

        return docs.mapInArrow(coded, _RELATION)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = _column(batch, 0, "und")
            for first, row, pos, word in _word_table(langs, batch.column(1)):
                at = pa.array(first + row)
                yield pa.RecordBatch.from_arrays([batch.column(2).take(at), pa.array(pos.astype(np.int32)), langs.take(at).cast(pa.string()), word.cast(pa.string())], ["row", "pos", "lang", "word"])

    placed = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(spread, "row long, pos int, lang string, word string")
    return _regrouped(_salted(placed, frequent, ["lang", "word"]))


def _extended(relation: DataFrame, frequent: DataFrame) -> DataFrame:
    """Occurrences of the next length: neighbours in position whose pair is a frequent group."""
    spark = relation.sparkSession
    if _small(frequent):
        left, right, gram = (c.to_numpy() for c in frequent.select("left", "right", "gram").toArrow().columns)
        width = int(right.max(initial=0)) + 1
        # the last frequent groups were small enough to be sent, or these are few: left and right stay below 2^31
        if int(left.max(initial=0)) < 1 << 31 and width <= 1 << 31:
            sent = spark.sparkContext.broadcast((pa.array(left * width + right), gram))

            def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                keys, grams = sent.value
                for batch in batches:
                    row, pos, a, b = _neighbours(batch)
                    found = np.asarray(pc.fill_null(pc.index_in(pa.array(np.where(b < width, a * width + b, -1)), keys), -1))
                    has = found >= 0
                    yield _record_batch(row[has], pos[has], grams[found[has]])

            return relation.mapInArrow(coded, _RELATION)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, a, b = _neighbours(batch)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(row)), pa.array(pos), pa.array(a), pa.array(b)], ["row", "pos", "left", "right"])

    placed = relation.withColumn("row", F.monotonically_increasing_id()).mapInArrow(spread, "row long, pos int, left long, right long")
    return _regrouped(_salted(placed, frequent, ["left", "right"]))


def _salted(rows: DataFrame, frequent: DataFrame, keys: list[str]) -> DataFrame:
    """Semi-join of occurrences with frequent groups too many to send; a very common group is spread over salts."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(joins.SALTS)))
    return salted.join(frequent.select(*keys, "gram", joins.every_salt().alias("_salt")), [*keys, "_salt"])


def _regrouped(found: DataFrame) -> DataFrame:
    """One record for each document again; a record is as long as its document."""
    records = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "gram"))).alias("_o"))
    return records.select(F.col("_o.pos").alias("pos"), F.col("_o.gram").alias("gram"))


def _attached(groups: DataFrame, below: DataFrame, side: str) -> DataFrame:
    """Columns of the group on one side, named after it."""
    table = joins.sized(below.select(F.col("gram").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("lang", "phrase", "last", "a", "f_first", "f_last", "f_head", "f_tail")]))
    return groups.join(table, side)


def frequent_phrases(docs: DataFrame, *, most_words: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """Frequent groups of 1 to ``most_words`` words, and the count of words of each lang.

    Each table: lang, gram (its number), phrase, a (occurrences), left and right
    (numbers of the phrase without its last and first word), f_first, f_last,
    f_head, f_tail (occurrences of the first and last word, and of left and
    right), last (its last word).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = scratch.cut(docs.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = scratch.cut(counted.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    single = _numbered(counted.where(F.col("a") >= least), scratch, "frequent")
    none = F.lit(None).cast("long")
    sizes = {c: F.col("a") for c in ("f_first", "f_last", "f_head", "f_tail")}
    tables = [single.select("lang", "gram", F.col("word").alias("phrase"), "a", none.alias("left"), none.alias("right"), F.col("word").alias("last"), *[v.alias(k) for k, v in sizes.items()])]
    relation = scratch.cut(_first_relation(docs, single), "relation1")
    for size in range(2, most_words + 1):
        groups = _numbered(_pair_counts(relation).where(F.col("a") >= least), scratch, "frequent")
        named = _attached(_attached(groups, tables[-1], "left"), tables[-1], "right").select(
            F.col("left_lang").alias("lang"),
            "gram",
            F.concat_ws(" ", "left_phrase", "right_last").alias("phrase"),
            "a",
            "left",
            "right",
            F.col("right_last").alias("last"),
            F.col("left_f_first").alias("f_first"),
            F.col("right_f_last").alias("f_last"),
            F.col("left_a").alias("f_head"),
            F.col("right_a").alias("f_tail"),
            F.col("left_f_head").alias("f_head2"),
            F.col("right_f_tail").alias("f_tail2"),
        )
        tables.append(scratch.cut(named, "named"))
        if size < most_words:
            relation = scratch.cut(_extended(relation, groups), f"relation{size}")
        scratch.drop(f"relation{size - 1}")
    return tables, totals


def _score(left: Column, right: Column) -> Column:
    """floor(2000000 a / (l + r)) in decimals of 38 digits, so that no product overflows."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(F.col("a")) * F.lit(2000000).cast("decimal(7,0)"), wide(left) + wide(right))


def collocations(docs: DataFrame, *, least: int = 30, absorbed: int = 80, best: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each lang's ``best`` phrases of two to four words.

    Words are maximal runs without blanks (space, tab) within pieces (ended by
    . , ; : ! ? and line breaks), A-Z lower-cased. A phrase that occurs
    ``least`` times or more is a candidate, with a occurrences (overlaps
    count). Of its cuts into l and r occurrences the one with the lowest score
    floor(2000000 a / (l + r)) counts, the first of equal ones. A candidate is
    dropped if a longer one that holds it has ``absorbed`` percent of its
    occurrences. (A phrase one word longer is enough to look at: it occurs at
    least as often as any yet longer one, so it is a candidate with them.)

    Returns lang (null: und), rank, phrase, a, l, r, n (words of the lang),
    score; rank by score, a, both falling, then phrase by bytes. Null and empty
    texts have no words; repeated rows count each; an empty table gives no
    rows; texts are taken whole, a long one as one record; other columns are
    ignored, whatever their names.
    """
    tables, totals = frequent_phrases(docs, least=least, text_col=text_col, lang_col=lang_col)
    c = F.col
    cuts = {
        2: [("f_first", "f_last")],
        3: [("f_first", "f_tail"), ("f_head", "f_last")],
        4: [("f_first", "f_tail"), ("f_head2", "f_tail2"), ("f_head", "f_last")],
    }
    found = None
    for size, pairs in cuts.items():
        table = tables[size - 1]
        scored = [F.struct(_score(c(a), c(b)).alias("score"), F.lit(k).alias("k"), c(a).alias("l"), c(b).alias("r")) for k, (a, b) in enumerate(pairs)]
        table = table.select("gram", "lang", "phrase", "a", F.array_min(F.array(*scored)).alias("cut"))
        if size < 4:
            longer = tables[size].select(F.explode(F.array("left", "right")).alias("gram"), c("a").alias("longer"))
            table = table.join(longer.groupBy("gram").agg(F.max("longer").alias("longer")), "gram", "left")
            table = table.where(c("longer").isNull() | (c("longer").cast("decimal(20,0)") * 100 < c("a").cast("decimal(20,0)") * absorbed)).drop("longer")
        part = table.select("lang", "phrase", "a", c("cut.l").alias("l"), c("cut.r").alias("r"), c("cut.score").alias("score"))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("lang").orderBy(c("score").desc(), c("a").desc(), "phrase")
    found = found.withColumn("rank", F.row_number().over(order)).where(c("rank") <= best)
    return found.join(joins.sized(totals), "lang").select("lang", c("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), counts AS (
  SELECT lang, 1 AS size, phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS phrase FROM listed) GROUP BY ALL
  UNION ALL
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, s.size, unnest(list_transform(range(1, len(w) - s.size + 2), lambda i: array_to_string(w[i:i + s.size - 1], ' '))) AS phrase
    FROM listed, (VALUES (2), (3), (4)) s(size) WHERE len(w) >= s.size
  ) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM candidates c JOIN (VALUES (1), (2), (3)) k(k) ON k.k < c.size
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k.k + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, a, unnest(list_transform(range(1, len(w) - s.size + 2), lambda i: array_to_string(w[i:i + s.size - 1], ' '))) AS phrase
  FROM candidates c, (VALUES (2), (3)) s(size) WHERE s.size < c.size
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT b.* FROM lowest b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.a IS NULL OR 100::HUGEINT * o.a < 80::HUGEINT * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""

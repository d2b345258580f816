"""Documents as token sequences of one length, with as little padding as possible.

Tokens are counted and placed by Spark; what is solved on the driver is a linear
program over the histogram of piece lengths, which has as many entries as a
sequence has tokens, whatever the corpus. A configuration is a multiset of
lengths that fits into one sequence.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwatch.llm import joins, words
from tarnwatch.scratch import Scratch

#: Words whose ids a Python worker keeps; later ones are encoded whenever they occur.
MOST_WORDS_KEPT = 1_000_000


#: How a tokenizer must split a text for its parts to be encoded apart: contractions, letters, single digits, all else. A fixed value.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Encoder:
    """Token ids of texts. Where a tokenizer lower-cases, drops blanks and splits by ``_PARTS``, each different word is encoded once.

    Then a text's ids are those of its blank-separated words in turn, and those
    of an ASCII word without an apostrophe are those of its runs of letters,
    digits and other characters, A-Z as a-z. ("<" may begin a special token, so
    words with it stay whole.) Texts of other tokenizers are encoded one by one.
    """

    _made: dict[str, _Encoder] = {}

    @classmethod
    def of(cls, path: str) -> _Encoder:
        """One for each worker and vocabulary, so that tasks of a worker share it."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores of a machine are Spark's to share out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rule = json.load(f)
        steps = lambda name, of: (x := rule.get(name) or {}).get(of) or [x]
        splits = [x.get("pattern", {}).get("Regex") for x in steps("pre_tokenizer", "pretokenizers")]
        self.by_words = splits[0] == _PARTS and {"type": "Lowercase"} in steps("normalizer", "normalizers")
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(words.SPACES)] = False
        self.kind = np.full(256, 3, dtype=np.uint8)
        self.kind[48:58], self.kind[65:91], self.kind[97:123] = 2, 1, 1
        self.folded = np.arange(256, dtype=np.uint8)
        self.folded[65:91] += 32
        self.whole = np.arange(256) > 127
        self.whole[[0x27, 0x3C]] = True
        self.kept = pa.array([], pa.large_string())
        self.ids, self.limits = np.zeros(1, dtype="<u4"), np.ones(1, dtype=np.int64)  # one id that no word has

    def _of_words(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) of each word; words beyond the bound are encoded and not kept."""
        at = pc.index_in(unique, self.kept)
        missing = unique.filter(pc.is_null(at))
        new = [e.ids for e in self.tokenizer.encode_batch_fast(missing.to_pylist(), add_special_tokens=False)]
        lengths = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        ids = np.concatenate([self.ids, np.array(list(itertools.chain.from_iterable(new)), dtype="<u4")])
        limits = np.concatenate([self.limits, self.limits[-1] + np.cumsum(lengths)])
        is_new = np.asarray(at.is_null())
        place = np.asarray(at.fill_null(0)).astype(np.int64)
        place[is_new] = len(self.kept) + np.arange(len(new))
        more = missing.slice(0, max(0, MOST_WORDS_KEPT - len(self.kept)))
        if len(more):
            self.kept = pa.concat_arrays([self.kept, more])
            self.limits = limits[: len(self.kept) + 1]
            self.ids = ids[: self.limits[-1]]
        return ids, limits[place], limits[place + 1] - limits[place]

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(text of each chunk, chunk), in order."""
        starts, ends, row = words.word_spans(data, offsets, self.inside)
        size = ends - starts
        letters = data[self.inside[data]]
        heads = np.cumsum(size) - size
        simple = np.ones(len(starts), dtype=bool)
        if len(starts):
            simple = np.repeat(~np.logical_or.reduceat(self.whole[letters], heads), size)
            letters = np.where(simple, self.folded[letters], letters)
        kind = self.kind[letters]
        begins = simple & ((kind == 2) | np.append(True, kind[1:] != kind[:-1])[: len(kind)])
        begins[heads] = True
        at = np.flatnonzero(begins)
        limits = np.append(at, len(letters)).astype(np.int64)
        word = np.searchsorted(heads, at, side="right") - 1
        return row[word], pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(limits), pa.py_buffer(letters))

    def encode(self, texts: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, rows, ids, limits) of runs of rows; each text's ids are followed by ``end``."""
        for first, rows, data, offsets in words.parts(texts, 1 << 23):
            if not self.by_words:
                found = self.tokenizer.encode_batch_fast([t or "" for t in texts.slice(first, rows).to_pylist()], add_special_tokens=False)
                yield first, rows, np.array([i for e in found for i in (*e.ids, end)], dtype="<u4"), np.cumsum([0, *[len(e.ids) + 1 for e in found]])
                continue
            row, chunk = self._chunks(data, offsets)
            found = chunk.dictionary_encode()
            ids, start, length = self._of_words(found.dictionary)
            code = np.asarray(found.indices)
            n = np.append(length[code], np.ones(rows, dtype=np.int64))
            source = np.append(start[code], np.full(rows, -1, dtype=np.int64))
            order = np.argsort(np.append(row, np.arange(rows)), kind="stable")  # each text's end after its words
            n, source = n[order], source[order]
            total = np.cumsum(n)
            at = np.repeat(source - (total - n), n) + np.arange(total[-1] if len(total) else 0)
            is_end = np.repeat(source < 0, n)
            out = np.where(is_end, np.uint32(end), ids[np.where(is_end, 0, at)]).astype("<u4")
            yield first, rows, out, np.concatenate([[0], np.flatnonzero(is_end) + 1])


def _lots(demand: np.ndarray) -> list[tuple[int, int]]:
    """(length, copies) such that sums of lots give every number of copies that is there and fits."""
    capacity = len(demand) - 1
    lots = []
    for length in np.flatnonzero(demand)[::-1].tolist():
        left, copies = min(int(demand[length]), capacity // length), 1
        while left:
            copies = min(copies, left)
            lots.append((length, copies))
            left -= copies
            copies *= 2
    return lots


def _priced(prices: np.ndarray, lots: list[tuple[int, int]], rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the most valuable filling of each room, as (place in rooms, lot) of all lots taken."""
    capacity = len(prices) - 1
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(lots), capacity + 1), dtype=bool)
    for i, (length, copies) in enumerate(lots):
        size = length * copies
        worth = best[:-size] + prices[length] * copies
        taken[i, size:] = worth > best[size:]
        best[size:] = np.maximum(worth, best[size:])
    left, places, chosen = rooms.copy(), [], []
    for i in range(len(lots) - 1, -1, -1):
        at = np.flatnonzero(taken[i, left])
        if len(at):
            left[at] -= lots[i][0] * lots[i][1]
            places.append(at)
            chosen.append(np.full(len(at), i))
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *places]), np.concatenate([empty, *chosen])


def _configurations(demand: np.ndarray, rounds: int, power: float = 4.0) -> dict[tuple[tuple[int, int], ...], float]:
    """A fractional cover of the demand by configurations, as sorted (length, copies): multiplicative weights, knapsack pricing.

    Each round fills an equal share of the sequences. A length that lags behind
    its share becomes dearer by a factor, one ahead of it cheaper. Every
    lagging length is completed to its most valuable configuration, and these
    share the round's sequences by how much of each length is missing.
    """
    capacity = len(demand) - 1
    lengths = np.flatnonzero(demand)
    lots = _lots(demand)
    lot_length, lot_copies = (np.array(x) for x in zip(*lots, strict=True))
    covered = np.zeros(capacity + 1)
    budget = float((demand * np.arange(capacity + 1)).sum()) / capacity / rounds
    uses: dict[tuple[tuple[int, int], ...], float] = {}
    for t in range(1, rounds + 1):
        lag = np.zeros(capacity + 1)
        lag[lengths] = t / rounds - covered[lengths] / demand[lengths]
        prices = np.arange(capacity + 1) / capacity * np.exp(np.clip(power * lag / t**0.5, -1, 1))
        leading = lengths[lag[lengths] > 0]
        place, lot = _priced(prices, lots, capacity - leading)
        counts = np.zeros((len(leading), capacity + 1), dtype=np.int32)
        counts[np.arange(len(leading)), leading] = 1
        np.add.at(counts, (place, lot_length[lot]), lot_copies[lot])
        missing = demand[leading] * lag[leading]
        share = missing * min(1.0, budget / max(missing.sum(), 1e-9))
        covered += share @ counts
        row, length = np.nonzero(counts)
        cuts = np.searchsorted(row, np.arange(1, len(leading)))
        copies = counts[row, length]
        for x, ls, cs in zip(share.tolist(), np.split(length, cuts), np.split(copies, cuts), strict=True):
            of = tuple(zip(ls.tolist(), cs.tolist(), strict=True))
            uses[of] = uses.get(of, 0.0) + x
    return uses


def _best_fit(demand: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """What rounding leaves: longest first, each into the fullest sequence that has room, equal ones at once."""
    capacity = len(demand) - 1
    open_: dict[int, list[list]] = {}  # room -> [configuration, how many]
    for length in np.flatnonzero(demand)[::-1]:
        length, left = int(length), int(demand[length])
        for room in range(length, capacity):
            while left and open_.get(room):
                configuration, n = open_[room].pop()
                k = min(n, left)
                if n > k:
                    open_[room].append([configuration, n - k])
                open_.setdefault(room - length, []).append([(*configuration, length), k])
                left -= k
            if not left:
                break
        each = capacity // length
        for k, n in ((each, left // each), (left % each, 1)):
            if k and n:
                open_.setdefault(capacity - k * length, []).append([(length,) * k, n])
    return [(tuple(c), n) for group in open_.values() for c, n in group]


def _rounded(demand: np.ndarray, rounds: int, repeats: int, only_full: bool) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The cover in whole numbers: among configurations with the same longest length, fractions are carried from one to the next.

    What the demand does not hold any more is left out and covered anew; what
    the last repeat leaves is packed by best fit.
    """
    left = demand.astype(np.int64).copy()
    capacity = len(demand) - 1
    packed: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for _ in range(repeats):
        before = int(left.sum())
        if not before:
            break
        due: dict[int, float] = {}
        for of, share in sorted(_configurations(left, rounds).items(), key=lambda x: (-x[1], x[0])):
            if only_full and sum(k * c for k, c in of) < capacity:
                continue
            longest = of[-1][0]
            due[longest] = due.get(longest, 0.5) + share
            n = min(int(due[longest]), *(int(left[k]) // c for k, c in of))
            if n:
                due[longest] -= n
                packed.append((of, n))
                for k, c in of:
                    left[k] -= n * c
        if int(left.sum()) > before * 0.95:
            break
    return packed + [(tuple(sorted((k, of.count(k)) for k in set(of))), n) for of, n in _best_fit(left)]


def solve(demand: np.ndarray, *, rounds: int = 16, repeats: int = 5) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations, as sorted (length, copies), with their numbers, that hold the demand exactly: ``demand[l]`` pieces of length l.

    The cover is rounded twice, with full configurations alone (better where
    short pieces abound) and with all (better where two or three pieces fill a
    sequence); the result with fewer sequences counts.
    """
    size = int((demand * np.arange(len(demand))).sum())
    found: list = []
    for only_full in (True, False):
        mine = _rounded(demand, rounds, repeats, only_full)
        if not found or sum(n for _, n in mine) < sum(n for _, n in found):
            found = mine
        if sum(n for _, n in found) == -(-size // (len(demand) - 1)):
            break  # no packing has fewer
    return found


def cut_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of at most ``capacity``: _id, piece, start, length, crc (of the ids as little-endian 32-bit numbers), part, place.

    A text's ids are followed by ``end``; only a longer text is cut. ``place``
    numbers the pieces of one length within a part, in order. ``with_ids``
    adds the ids themselves.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _Encoder.of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for first, rows, ids, limits in encoder.encode(batch.column(1), end):
                total = np.diff(limits)
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(rows), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                at = limits[row] + start
                crc = np.fromiter((zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), dtype=np.int64, count=len(at))
                order = np.argsort(length, kind="stable")
                heads = np.searchsorted(length[order], length[order])
                place = np.empty(len(row), dtype=np.int64)
                place[order] = np.arange(len(row)) - heads + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), part, dtype=np.int32)), pa.array(place)]
                names = ["_id", "piece", "start", "length", "crc", "part", "place"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, limits[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"_id {id_type}, piece int, start long, length long, crc long, part int, place long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def _slots(found: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks of a length, sorted: which sequences they fill, how many pieces each, and from where."""
    rows, taken, sequences = [], {}, 0
    for of, n in found:
        offset = 0
        for length, copies in of:
            rows.append((length, taken.get(length, 0), sequences, copies, offset))
            taken[length] = taken.get(length, 0) + n * copies
            offset += length * copies
        sequences += n
    return dict(zip(("length", "rank", "sequence", "copies", "offset"), np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T, strict=True))


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end: int = 0, rounds: int = 16, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places every piece of every document in a sequence of at most ``capacity`` tokens, in as few sequences as it can.

    A configuration linear program over the histogram of lengths (``capacity``
    counts on the driver, whatever the corpus) is solved by multiplicative
    weights and rounded. It yields, for each length, runs of ranks with their
    sequences and offsets, some 10,000 short rows that are sent to all tasks;
    a piece finds its run by its rank among the pieces of its length: its place
    in its part of the written table, plus what earlier parts hold.

    Returns _id, piece, start, length, crc, sequence_id, offset (and ids with
    ``with_ids``). Sequence numbers have no gaps, and offsets of a sequence
    follow each other. A null or empty text is ``end`` alone; ids may be null
    or repeat, each row is packed; a long text is cut into full pieces and a
    rest; other columns are ignored, whatever their names; an empty table gives
    no rows. Ranks are those of the written table, so a lost executor changes
    nothing; equal lengths are interchangeable.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.cut(cut_pieces(docs, tokenizer, capacity=capacity, end=end, with_ids=with_ids, id_col=id_col, text_col=text_col), "pieces")
    counts = scratch.cut(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        demand[r.length] = r.n
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = joins.sized(scratch.cut(counts.select("part", "length", before.alias("before")), "before"))
    slots = spark.sparkContext.broadcast(_slots(solve(demand, rounds=rounds)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = slots.value
        heads = np.searchsorted(runs["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            run = np.empty(len(rank), dtype=np.int64)
            for k in np.unique(length):
                of = length == k
                run[of] = heads[k] + np.searchsorted(runs["rank"][heads[k] : heads[k + 1]], rank[of], side="right") - 1
            within = rank - runs["rank"][run]
            copies = runs["copies"][run]
            sequence, offset = runs["sequence"][run] + within // copies, runs["offset"][run] + within % copies * length
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, n_pieces, tokens. A group is one sequence, so it is small."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("tokens"))


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("_id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")

"""Removal of byte strings that other documents hold: a blockwise suffix sort with a cover sample.

A suffix array of the whole corpus is never built at once. Any 50 bytes hold a
sample: the 24-byte string in them whose hash is smallest. So equal strings of
50 bytes hold the same sample at the same place, which is what a difference
cover grants its pairs of suffixes, and samples are 7 % of all positions.

1. Samples are named over all documents; those that one document alone holds go.
2. The others are dealt into buckets with what surrounds them: up to 26 bytes on
   either side. Within a packed group of texts equal surroundings are one
   record with the smallest and the largest id that has them.
3. One bucket is sorted at a time. Its samples get ranks by their bytes; records
   are sorted by (rank, bytes before it, read backwards) and by (rank, bytes
   after it). Common prefixes of neighbours in these two orders tell which
   50-byte strings are equal, so that a long tie is settled by the sample's
   rank and two classes, and equality is always that of bytes.
4. Each group learns the smallest id that holds each of its strings, and
   removes them from documents with larger ids.

A bucket holds some 4 MB of text on average. A passage that very many documents
hold is one sample's bucket, but only one record of it for each group (half a
megabyte of text, some hundred documents) reaches that bucket.

Texts travel in packed groups, so that a row of a shuffle holds some hundred
documents or samples, and a task little memory.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm import words
from tarnwatch.llm.joins import sized
from tarnwatch.scratch import Scratch

#: Bytes of a string that counts as a repeat, and of a sample.
LENGTH, SAMPLE = 50, 24
#: Groups whose samples share a row of the shuffle.
FLUSH = 32
#: Bytes of text in a group; a longer text is a group of its own.
GROUP_BYTES = 1 << 19
#: Text for each bucket, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 22, 64
#: Bytes of a 50-byte string that are not its sample.
REST = LENGTH - SAMPLE
_VALUES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_LAST = np.iinfo(np.int64).max


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(struct.pack("<q", a.nbytes) + a.tobytes() for a in arrays)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, *types) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], struct.unpack_from("<q", blob)[0], codec="zstd", asbytes=True)
    out, at = [], 0
    for t in types:
        n = struct.unpack_from("<q", raw, at)[0]
        out.append(np.frombuffer(raw, dtype=t, count=n // np.dtype(t).itemsize, offset=at + 8))
        at += 8 + n
    return out


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = words.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def sample_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of 50 bytes with the same sample: text, first window, windows, the sample's place, 48 bits of its hash, and which run is the first with the same bytes."""
    if len(data) < LENGTH:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sums, down = _sums(data)
    hashes = words.mixed((sums[SAMPLE:] - sums[:-SAMPLE]) * down[: len(data) - SAMPLE + 1])
    least, width = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * width <= LENGTH - SAMPLE + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = LENGTH - SAMPLE + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    at = np.flatnonzero(np.arange(LENGTH, LENGTH + len(least)) <= offsets[text + 1])
    place = (least[at] & _LOW).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n, begin, sample = np.diff(np.append(first, len(at))), at[first], place[first]
    return text[begin], begin, n, sample, hashes[sample] >> np.uint64(16), _first_alike(data, sums, down, begin, n, sample)


def _first_alike(data, sums, down, begin, n, sample) -> np.ndarray:
    """For each run the first one with the same bytes and sample. Hashes find it, bytes confirm it."""
    end = begin + n + LENGTH - 1
    name = words.mixed((sums[end] - sums[begin]) * down[begin]) + words.mixed(((sample - begin) * 64 + n).astype(np.uint64))
    _, leader, which = np.unique(name, return_index=True, return_inverse=True)
    leader = leader[which]
    again = np.flatnonzero(leader != np.arange(len(leader)))
    lengths = (end - begin)[again]
    inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    differ = data[np.repeat(begin[again], lengths) + inner] != data[np.minimum(np.repeat(begin[leader[again]], lengths) + inner, len(data) - 1)]
    wrong = np.unique(np.repeat(again, lengths)[differ])
    leader[wrong] = wrong
    return leader


def _pack_groups(batches):
    rng = np.random.default_rng()  # group names only have to differ
    for batch in batches:
        ids = batch.column("id").fill_null(_LAST).to_numpy()
        for first, n, data, offsets in words.parts(batch.column("text"), GROUP_BYTES):
            yield _batch([(int(rng.integers(1, _LAST)), _packed(ids[first : first + n], offsets, data))], ("g", "texts"))


def _open(blob: bytes):
    return _unpacked(blob, np.int64, np.int64, np.uint8)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Samples have the smallest hashes of their windows, so the hashes are mixed again to spread them evenly."""
    return ((words.mixed(hashes) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class _Dealer:
    """Gathers arrays of several groups and gives them out by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.held = buckets, []

    def add(self, g: int, hashes: np.ndarray, *arrays: np.ndarray):
        self.held.append((_bucket(hashes, self.buckets), np.full(len(hashes), g, dtype=np.int64), *arrays))

    def rows(self):
        if not self.held:
            return
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held = []
        order = np.argsort(columns[0], kind="stable")
        cuts = np.flatnonzero(np.diff(columns[0][order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(columns[0][part[0]]), [c[part] for c in columns[1:]]


def _batch(rows: list, names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=list(names))


def _samples(buckets: int):
    """The distinct samples of a group, and whether two of its documents hold each."""

    def run(batches):
        dealer, held = _Dealer(buckets), 0
        give = lambda: _batch([(b, _packed(g, several, h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16))) for b, (g, several, h) in dealer.rows()], ("bucket", "blob"))
        for batch in batches:
            for g, blob in zip(batch.column("g").to_pylist(), batch.column("texts"), strict=True):
                ids, offsets, data = _open(blob.as_py())
                text, _, _, _, hashes, _ = sample_runs(data, offsets)
                order = np.argsort(hashes, kind="stable")
                owner, hashes = ids[text][order], hashes[order]
                first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
                several = (np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first)) if len(first) else np.zeros(0, bool)
                dealer.add(g, hashes[first], several.astype(np.uint8), hashes[first])
                held += 1
                if held % FLUSH == 0:
                    yield give()
        yield give()

    return run


def _by_group(groups: np.ndarray, *arrays: np.ndarray) -> list:
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.diff(groups[order])) + 1
    return [(int(groups[p[0]]), _packed(*[a[p] for a in arrays])) for p in np.split(order, cuts) if len(p)]


def _repeated(table: pa.Table) -> pa.Table:
    """Samples of one bucket that two documents or more hold."""
    parts = [_unpacked(b.as_py(), np.int64, np.uint8, np.uint32, np.uint16) for b in table.column("blob")]
    groups, several, low, high = (np.concatenate(c) for c in zip(*parts, strict=True))
    hashes = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = s[1:] == s[:-1]
    shared = order[np.append(same, False) | np.append(False, same) | (several[order] > 0)]
    return pa.Table.from_batches([_batch(_by_group(groups[shared], hashes[shared]), ("g", "blob"))])


def _suffixes(buckets: int):
    """Records of shared samples: the first run alike, the smallest and the largest id, windows, the sample's place, bytes."""

    def run(batches):
        dealer, held = _Dealer(buckets), 0
        texts: list[np.ndarray] = []

        def give():
            rows, base = [], np.concatenate(texts) if texts else np.zeros(0, np.uint8)
            for b, (g, r, least, most, at, n, place) in dealer.rows():
                lengths = n + LENGTH - 1
                where = np.repeat(at - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                rows.append((b, _packed(g, r.astype(np.uint32), least, most, n.astype(np.uint8), place.astype(np.uint8), base[where])))
            texts.clear()
            return _batch(rows, ("bucket", "blob"))

        for batch in batches:
            for g, blob, found in zip(batch.column("g").to_pylist(), batch.column("texts"), batch.column("found"), strict=True):
                ids, offsets, data = _open(blob.as_py())
                text, first, n, sample, hashes, leader = sample_runs(data, offsets)
                known = np.concatenate([_unpacked(b, np.uint64)[0] for b in found.as_py()])
                least, most = np.full(len(text), _LAST), np.full(len(text), np.iinfo(np.int64).min)
                np.minimum.at(least, leader, ids[text]), np.maximum.at(most, leader, ids[text])
                r = np.flatnonzero((leader == np.arange(len(leader))) & np.isin(hashes, known))
                before = sum(len(t) for t in texts)
                texts.append(data)
                dealer.add(g, hashes[r], r, least[r], most[r], first[r] + before, n[r], sample[r] - first[r])
                held += 1
                if held % FLUSH == 0:
                    yield give()
        yield give()

    return run


def _keys(rows: np.ndarray) -> list[np.ndarray]:
    """Bytes of each row as big-endian numbers, so that their order is that of the bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(wide.view(">u8").astype(np.uint64).T)


def _ranked(rows: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (rank, bytes), and for each row in it the length of the prefix it shares with the one before; -1 for another rank."""
    order = np.lexsort([*reversed(_keys(rows)), rank])
    differ = rows[order][1:] != rows[order][:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    shared[rank[order][1:] != rank[order][:-1]] = -1
    return order, np.append(-1, shared)


def _context(data: np.ndarray, at: np.ndarray, length: np.ndarray, step: int) -> np.ndarray:
    """Up to 26 bytes from each place, forwards or backwards; zeros beyond ``length``."""
    k = np.arange(REST)
    return np.where(k < length[:, None], data[np.clip(at[:, None] + step * k, 0, len(data) - 1)], 0).astype(np.uint8)


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """Sorts one bucket's suffixes. For each group: runs of windows of its records, and the smallest id that holds them."""
    parts = [_unpacked(b.as_py(), np.int64, np.uint32, np.int64, np.int64, np.uint8, np.uint8, np.uint8) for b in table.column("blob")]
    groups, run, least, most, n, place, data = (np.concatenate(c) for c in zip(*parts, strict=True))
    n, place = n.astype(np.int64), place.astype(np.int64)
    ends = np.cumsum(n + LENGTH - 1)
    sample = ends - (n + LENGTH - 1) + place
    strings = data[sample[:, None] + np.arange(SAMPLE)]
    order, shared = _ranked(strings, np.zeros(len(strings), np.int64))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(shared < SAMPLE)
    before = _ranked(_context(data, sample - 1, place, -1), rank)
    after = _ranked(_context(data, sample + SAMPLE, ends - sample - SAMPLE, 1), rank)

    def classes(ranked, length):
        out = np.empty(len(rank), np.int64)
        out[ranked[0]] = np.cumsum(ranked[1] < length)
        return out

    found = []
    for s in range(REST + 1):  # windows in which the sample has s bytes before it
        own = np.flatnonzero((place - n < s) & (s <= place))
        if not len(own):
            continue
        key = classes(before, s)[own] * (len(rank) + 1) + classes(after, REST - s)[own]
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        smallest = np.empty(len(own), np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(least[own][order], edges), np.diff(np.append(edges, len(order))))
        gone = np.flatnonzero(most[own] > smallest)
        found.append((own[gone], (place[own] - s)[gone], smallest[gone]))
    record, window, smallest = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((window, record))
    record, window, smallest = record[order], window[order], smallest[order]
    new = np.ones(len(record), dtype=bool)
    new[1:] = (window[1:] != window[:-1] + 1) | (record[1:] != record[:-1]) | (smallest[1:] != smallest[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(record)))
    record, window, smallest = record[begin], window[begin], smallest[begin]
    rows = _by_group(groups[record], run[record], window.astype(np.uint8), count.astype(np.uint8), smallest)
    return pa.Table.from_batches([_batch(rows, ("g", "blob"))])


def _remove(keep: bool):
    def run(batches):
        for batch in batches:
            for blob, found in zip(batch.column("texts"), batch.column("found"), strict=True):
                ids, offsets, data = _open(blob.as_py())
                steps = np.zeros(len(data) + 1, dtype=np.int32)
                if found is not None and found.as_py():
                    text, first, _, _, _, leader = sample_runs(data, offsets)
                    alike = np.argsort(leader, kind="stable")
                    run, window, n, smallest = (np.concatenate(c) for c in zip(*[_unpacked(b, np.uint32, np.uint8, np.uint8, np.int64) for b in found.as_py()], strict=True))
                    low, high = np.searchsorted(leader[alike], run, "left"), np.searchsorted(leader[alike], run, "right")
                    told = np.repeat(np.arange(len(run)), high - low)
                    own = alike[np.arange(len(told)) - np.repeat(np.cumsum(high - low) - high, high - low)]
                    later = ids[text[own]] > smallest[told]
                    told, own = told[later], own[later]
                    begin = first[own] + window[told]
                    np.add.at(steps, begin, 1)
                    np.add.at(steps, begin + n[told] + LENGTH - 1, -1)
                gone = np.cumsum(steps[:-1]) > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                opens[offsets[:-1]] = gone[offsets[:-1]]
                removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, opens))
                texts = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                        pa.array(texts if keep else [None] * len(texts), pa.binary()),
                    ],
                    names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


RESULT = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(df: DataFrame, *, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte covered by a 50-byte string that a document with a smaller id holds too.

    Strings are judged on the input: what is removed elsewhere still counts.
    Whole copies of a text go first (grouped by their digest); other texts go
    through the sample, bucket and removal steps of this module.

    Returns one row for each input row: _id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256, kept (the bytes that stay, which may
    end within a character; null without ``keep``). Null counts as empty; texts below 50 bytes stay
    whole; rows with the same id do not remove from each other; a null id is
    larger than all others; an empty table gives no rows. A long text is a
    group of its own and is held in memory as a whole, with some 60 bytes for
    each of its bytes while it is hashed. Extra columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "repeats")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    total = scratch.cut(rows.where(F.octet_length("text") >= LENGTH).groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.first(F.octet_length("text")).cast("long").alias("n")), "digests")
    size = total.agg(F.sum("n")).first()[0] or 0
    buckets = int(max(LEAST_BUCKETS, size // BUCKET_BYTES))
    digests = rows.where(F.octet_length("text") >= LENGTH).select("id", "digest")
    several = sized(total.where("least < most").select("digest", "least"))
    copies = scratch.cut(digests.join(several, "digest").where("id > least").select("id", "digest").distinct(), "copies")
    copies = sized(copies)

    long = F.octet_length("text") >= LENGTH
    packed = scratch.cut(rows.where(long).join(copies, ["id", "digest"], "left_anti").select("id", "text").mapInArrow(_pack_groups, "g long, texts binary"), "packed")
    samples = packed.mapInArrow(_samples(buckets), "bucket long, blob binary")
    shared = samples.groupBy("bucket").applyInArrow(_repeated, "g long, blob binary").groupBy("g").agg(F.collect_list("blob").alias("found"))
    suffixes = packed.join(shared, "g").mapInArrow(_suffixes(buckets), "bucket long, blob binary")
    gone = suffixes.groupBy("bucket").applyInArrow(_sorted_bucket, "g long, blob binary").groupBy("g").agg(F.collect_list("blob").alias("found"))
    gone = scratch.cut(gone, "gone")
    cleaned = packed.join(gone, "g", "left").mapInArrow(_remove(keep), RESULT)

    n = F.octet_length("text").cast("long")
    nothing = F.lit(0).cast("long")
    short = rows.where(~long).select(F.col("id").alias("_id"), n.alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), (F.encode("text", "UTF-8") if keep else F.lit(None).cast("binary")).alias("kept"))
    whole = rows.join(copies, ["id", "digest"]).select(F.col("id").alias("_id"), n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(b"" if keep else None).cast("binary").alias("kept"))
    return cleaned.union(short).union(whole)


def op7_suffixes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, keep=False).select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")

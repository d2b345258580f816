"""Phrases, filter audit and packing: brute-force versions, edge cases, hot groups."""

import itertools
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from tarnwatch.llm import filter_audit, joins, packing, phrases, queries  # noqa: E402
from test_corpus import CLASHES, DOCS, clashing, odd_documents  # noqa: E402

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
FOLD = {i: i + 32 for i in range(65, 91)}


def plain_collocations(rows, least, absorbed, best):
    import re

    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    count[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {q for p, a in candidates.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if 100 * a >= absorbed * candidates[q := p[i : i + n]]}
        found = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def collected(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def phrase_rows():
    rng = random.Random(5)
    vocabulary = ["of", "THE", "Öl", "new", "york", "city", "a", "b", "über", "x-y"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!"]) for _ in range(rng.randint(0, 120)))
    rows = [(rng.choice(["en", "en", "en", "de", None, "und", ""]), text()) for _ in range(150)]
    return [*rows, (None, None), ("fr", None), ("en", ""), ("en", " .,;\t\n"), ("en", "a a a a a a a a"), ("en", "new york city " * 3000), *rows[:3]]


@pytest.mark.parametrize("sent", [True, False])
def test_collocations(spark, monkeypatch, sent):
    if not sent:  # groups too many to send: salted joins
        monkeypatch.setattr(joins, "MOST_BYTES", 0)
    rows = phrase_rows()
    df = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(5))
    for least, best in ((5, 40), (30, 2000)):
        assert collected(phrases.collocations(df, least=least, best=best)) == plain_collocations(rows, least, 80, best)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None, None, None, None, None, None)], DOCS), least=1).count() == 0
    assert phrases.collocations(odd_documents(spark), least=1).count() > 0


def plain_audit(rows, labels):
    """Each order applied to the rows one filter after the other."""
    import re

    good, toxic, first = {}, {}, {}
    for i, q, t in [x for x in labels if x[0] is not None]:
        good[i], toxic[i] = good.get(i, False) or q == 1, toxic.get(i, False) or t == 1
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    fails = []
    for i, text, part in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i,
        }
        fails.append((part or "", {k for k, v in f.items() if v}, good.get(i, False), toxic.get(i, False)))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                gone, left = [f for f in left if k in f[1]], [f for f in left if k not in f[1]]
                shapley[part, k] += len(gone)
                failing = sum(k in f[1] for f in mine)
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(f[1] == {k} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_filter_audit(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "MOST_BYTES", 0)
    monkeypatch.setattr(filter_audit, "PART_OF_COPIES", 20)
    rng = random.Random(9)
    rows = [(r.doc_id, r.text, r.source) for r in odd_documents(spark).collect()]
    words = [f"w{k}" for k in range(300)]
    for i in range(100, 220):
        rows.append((i, " ".join(rng.choices(words, k=rng.choice([3, 150, 250, 900]))) + rng.choice(["", " #", " ABCDEFGH " * 9]), rng.choice(["a", "b", "", None])))
    rows += [(rng.choice([5, 300, 301, 302, None]), "one hot copy", "a") for _ in range(150)]
    rows += [(i + 1000, rows[i][1], "b") for i in range(20, 60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(0, 200), *range(150, 200), 300]] + [(None, 1, 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6))
    found = audited(filter_audit.audit(filter_audit.failure_counts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))))
    assert found == plain_audit(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failure_counts(docs, labels)).count() == 0
    one = spark.createDataFrame([(None,) * 7], DOCS)
    rows = filter_audit.audit(filter_audit.failure_counts(one, labels)).collect()
    assert len(rows) == 600 and all(r.part == "" and r.kept == (0 if "A" in r.filter_order[: r.step] else 1) for r in rows)


def packed_right(rows, capacity, packed):
    """Every text comes back from its pieces, and sequences have no gap and no overlap."""
    tokenizer = packing._Encoder.of(TOKENIZER).tokenizer
    expected = Counter()
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for p, start in enumerate(range(0, len(ids), capacity)):
            piece = ids[start : start + capacity]
            expected[i, p, start, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes()), tuple(piece)] += 1
    assert expected == Counter((r._id, r.piece, r.start, r.length, r.crc, tuple(r.ids)) for r in packed)
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for of in by.values():
        end = 0
        for offset, length in sorted(of):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_pack(spark):
    odd = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for capacity in (64, 2048):
        packed = packing.pack(clashing(odd.repartition(3)), TOKENIZER, capacity=capacity, with_ids=True).cache()
        n = packed_right(rows, capacity, packed.collect())
        tokens = packed.agg(F.sum("length")).head()[0]
        assert n <= tokens / capacity * 1.05 + 2
        whole = packing.sequences(packed).agg(F.count(F.lit(1)), F.sum(F.size("tokens")), F.max(F.size("tokens"))).head()
        assert whole[0] == n and whole[1] == tokens and whole[2] <= capacity
    assert packing.pack(spark.createDataFrame([], DOCS), TOKENIZER).count() == 0


def test_op13_is_near_the_bound(spark, sf):
    rows = queries.QUERIES["op13_pack"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert {r.doc_id for r in rows} == {d.doc_id for d in docs}
    tokenizer = packing._Encoder.of(TOKENIZER).tokenizer
    texts = {d.doc_id: tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0] for d in docs}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(texts[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, texts.values()))
    assert len({r.sequence_id for r in rows}) <= -(-sum(map(len, texts.values())) // 2048) + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aZ9,.'<|>e\u0301İßΣ \t\n-", max_size=30), st.sampled_from(["<|endoftext|>x", "a<|STARTOFTEXT|>", "don'tX9,,a", "H\u0331 12ab"])), max_size=6))
def test_ids_of_words_are_those_of_texts(texts):
    encoder = packing._Encoder.of(TOKENIZER)
    assert encoder.by_words
    mine = [ids[limits[k] : limits[k + 1]].tolist() for _, rows, ids, limits in encoder.encode(pa.array(texts, pa.string()), 7) for k in range(rows)]
    assert mine == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [7] for t in texts]


def test_ids_of_another_tokenizer():
    encoder = packing._Encoder.of(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  words, 12!", None, ""]
    mine = [ids[limits[k] : limits[k + 1]].tolist() for _, rows, ids, limits in encoder.encode(pa.array(texts), 3) for k in range(rows)]
    assert not encoder.by_words and mine == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [3] for t in texts]


def test_ids_when_no_more_words_are_kept(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS_KEPT", 3)
    encoder = packing._Encoder(TOKENIZER)
    for texts in (["one two three four", "five"], ["four five six one", "", "seven one"], ["two eight"]):
        mine = [ids[limits[k] : limits[k + 1]].tolist() for _, rows, ids, limits in encoder.encode(pa.array(texts), 0) for k in range(rows)]
        assert mine == [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert len(encoder.kept) == 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_configurations_hold_the_demand(lengths):
    demand = np.bincount(lengths, minlength=51)
    found = packing.solve(demand, rounds=4, repeats=2)
    held = np.zeros(51, dtype=np.int64)
    for of, n in found:
        assert n > 0 and sum(k * c for k, c in of) <= 50
        for k, c in of:
            held[k] += n * c
    assert (held == demand).all()


def test_packing_is_as_good_as_best_fit():
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(6, 1, 20000).astype(int) + 1, 2048)
    demand = np.bincount(lengths, minlength=2049)
    bound = max(-(-lengths.sum() // 2048), (lengths > 1024).sum())
    n = sum(n for _, n in packing.solve(demand))
    assert n <= bound * 1.002 and n <= sum(k for _, k in packing._best_fit(demand))

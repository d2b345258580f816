"""Secret scan: fixed credential patterns, and a battery of randomness tests. DataFrame functions only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.scratch import Scratch

#: The base patterns, the group that is measured, its least length in characters.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Runs of characters that common encodings use.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order tried: what a token matches, its alphabet, and the
#: index of coincidence of ordinary (not random) strings in it. The last takes every token.
ENCODINGS = (
    ("decimal", "^[0-9]+$", _DIGITS, 0.20),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.12),
    ("lower", "^[a-z]+$", _LOWER, 0.065),
    ("upper", "^[A-Z]+$", _UPPER, 0.065),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567=", 0.065),
    ("alphanumeric", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, 0.065),
    ("base64url", "^[A-Za-z0-9_=-]+$", _UPPER + _LOWER + _DIGITS + "-_=", 0.065),
    ("base64", "", _UPPER + _LOWER + _DIGITS + "+/-_=", 0.065),
)
#: Length classes are powers of two: 0 for 20 to 31 characters, 1 for 32 to 63, and so on, at most 15.
MOST_CLASSES = 16
#: p-values are binned by -20 log10 p, at most 400.
BINS_PER_DECADE, MOST_BINS = 20, 400
#: Runs and serial statistics are binned by a quarter of a standard deviation, at most 40 bins.
Z_BINS = 40
#: Tokens are surely ordinary, and count for what is usual among those, if uniformity has a smaller p-value than this.
ORDINARY = 1e-4
#: The combined p-value of the battery at which a token does not fit a random string.
MISFIT = 0.001


def _spans(text: Column, pattern: str, group: int, least: int, kind: str, order: int) -> Column:
    """Spans of leftmost non-overlapping matches in code points: pieces between matches and the matches add up."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(whole, F.length).alias("len"),
        F.transform(measured, F.length).alias("measured"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,measured:int>>").alias("found"))

    def step(acc, m):
        begin = acc["at"] + m["gap"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), (begin + m["len"]).alias("end"), m["measured"].alias("measured"))
        return F.struct((begin + F.coalesce(m["len"], F.lit(0))).alias("at"), F.when(m["measured"] >= least, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(lengths, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(start["found"])


def _normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, absolute error below 7.5e-8; tails by the Mills ratio."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-a * a / 2) * 0.3989422804014327
    tail = F.when(a < 6, density * poly).otherwise(density / F.greatest(a, F.lit(1.0)))
    return F.when(z < 0, tail).otherwise(1 - tail)


def _cauchy(*p: Column) -> Column:
    """Cauchy combination of p-values that may depend on each other, each weighing the same."""
    bend = lambda x: F.when(x < 1e-8, 1 / (x * math.pi)).otherwise(F.tan((0.5 - x) * math.pi))
    t = sum((bend(F.least(F.greatest(x, F.lit(1e-30)), F.lit(0.999))) for x in p[1:]), bend(F.least(F.greatest(p[0], F.lit(1e-30)), F.lit(0.999)))) / len(p)
    return F.when(t > 1e8, 1 / (t * math.pi)).otherwise(0.5 - F.atan(t) / math.pi)


def _battery(tokens: Column) -> Column:
    """array<struct<start,end,token>> -> array<struct<start,end,strata,chi,runs,serial,plain,fits>>."""

    def pick(token, what):
        chosen = F.lit(what(ENCODINGS[-1]))
        for e in reversed(ENCODINGS[:-1]):
            chosen = F.when(token.rlike(e[1]), F.lit(what(e))).otherwise(chosen)
        return chosen

    coded = F.transform(
        tokens,
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), F.length(c["token"]).cast("double").alias("n"), F.when(c["token"].rlike("^[0-9A-F]+$"), F.lower(c["token"])).otherwise(c["token"]).alias("token"),
            pick(c["token"], lambda e: e[2]).alias("alphabet"), pick(c["token"], lambda e: e[3]).alias("coincidence"),
        ),
    )
    valued = F.transform(
        coded,
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["n"].alias("n"), F.length(c["alphabet"]).cast("double").alias("k"), c["coincidence"].alias("coincidence"),
            F.aggregate(F.transform(F.array_distinct(F.split(c["token"], "")), lambda ch: F.pow(c["n"] - F.length(F.replace(c["token"], ch, F.lit(""))), 2.0)), F.lit(0.0), lambda a, x: a + x).alias("squares"),
            F.transform(F.split(c["token"], ""), lambda ch: F.instr(c["alphabet"], ch).cast("double")).alias("v"),
        ),
    )
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    pairs = lambda c, f: F.zip_with(F.slice(c["v"], F.lit(1), (c["n"] - 1).cast("int")), F.slice(c["v"], F.lit(2), (c["n"] - 1).cast("int")), f)
    summed = F.transform(
        valued,
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["n"].alias("n"), c["k"].alias("k"), c["coincidence"].alias("coincidence"),
            (c["squares"] * c["k"] / c["n"] - c["n"]).alias("chi"),
            (total(c["v"]) / c["n"]).alias("mean"), total(F.transform(c["v"], lambda x: x * x)).alias("vv"), total(pairs(c, lambda a, b: a * b)).alias("lag"),
            F.element_at(c["v"], 1).alias("first"), F.element_at(c["v"], -1).alias("last"),
            (total(pairs(c, lambda a, b: F.when((a > c["k"] / 2) != (b > c["k"] / 2), 1.0).otherwise(0.0))) + 1).alias("runs"),
            total(F.transform(c["v"], lambda x: F.when(x > c["k"] / 2, 1.0).otherwise(0.0))).alias("high"),
        ),
    )

    def scored(c):
        n, k = c["n"], c["k"]
        excess = k * c["coincidence"] - 1  # of an ordinary string, for each character
        ordinary = (c["chi"] - (k - 1) - (n - 1) * excess) / F.sqrt(2 * (k - 1) + 4 * (n - 1) * excess)
        uniform = (c["chi"] - (k - 1)) / F.sqrt(2 * (k - 1))
        both = 2 * c["high"] * (n - c["high"])
        runs = F.when(both > n, (c["runs"] - both / n - 1) / F.sqrt(both * (both - n) / (n * n * (n - 1)))).otherwise(F.lit(99.0))
        spread = c["vv"] - n * c["mean"] * c["mean"]
        lagged = c["lag"] - c["mean"] * (2 * n * c["mean"] - c["first"] - c["last"]) + (n - 1) * c["mean"] * c["mean"]
        serial = F.when(spread > 0, lagged / spread * F.sqrt(n)).otherwise(F.lit(99.0))
        p_uniform = 1 - _normal_cdf(uniform)
        fits = _cauchy(p_uniform, 2 * _normal_cdf(-F.abs(runs)), 2 * _normal_cdf(-F.abs(serial))) >= MISFIT
        strata = F.least(F.floor(F.log2(n / 16)), F.lit(MOST_CLASSES - 1)).cast("int")
        binned = lambda z: F.least(F.floor(F.abs(z) * 4), F.lit(Z_BINS - 1)).cast("int")
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), strata.alias("strata"), F.greatest(_normal_cdf(ordinary), F.lit(1e-30)).alias("chi"), binned(runs).alias("runs"), binned(serial).alias("serial"),
            (p_uniform < ORDINARY).alias("plain"), fits.alias("fits"),
        )

    return F.transform(summed, scored)


def _candidates(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    pieces = F.arrays_zip(F.transform(F.split(text, CANDIDATE, -1), F.length).alias("gap"), tokens.alias("token"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,token:string>>").alias("found"))

    def step(acc, m):
        begin = acc["at"] + m["gap"]
        end = begin + F.coalesce(F.length(m["token"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(m["token"].isNotNull(), F.array_append(acc["found"], F.struct(begin.alias("start"), end.alias("end"), m["token"].alias("token")))).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(CANDIDATE), F.aggregate(pieces, start, step, lambda acc: acc["found"])).otherwise(start["found"])


def usual(found: DataFrame, test: str) -> list[float]:
    """For each length class and bin: how often an ordinary token's statistic is as near to a random string's.

    Classes times bins bound the counts that reach the driver. A class
    without ordinary tokens gives 1/2, which says nothing.
    """
    bins = found.select(F.explode("tests").alias("t")).where("t.plain").groupBy("t.strata", f"t.{test}").count().collect()
    counts = np.zeros((MOST_CLASSES, Z_BINS))
    for r in bins:
        counts[r["strata"], r[test]] = r["count"]
    return ((counts.cumsum(axis=1) + 1) / (counts.sum(axis=1, keepdims=True) + 2)).ravel().tolist()


def _bin(t: Column, runs: list[float], serial: list[float]) -> Column:
    """The combined p-value of the three tests, binned."""
    at = lambda table, test: F.element_at(F.lit(table), t["strata"] * Z_BINS + t[test] + 1)
    p = _cauchy(t["chi"], at(runs, "runs"), at(serial, "serial"))
    return F.greatest(F.lit(0), F.least(F.floor(-F.log10(p) * BINS_PER_DECADE), F.lit(MOST_BINS))).cast("int")


def thresholds(binned: DataFrame, q: float) -> dict[int, int]:
    """Benjamini-Hochberg in each length class: the least bin that is a discovery. Classes times bins bound the counts."""
    bins = binned.groupBy("strata", "bin").count().collect()
    least = {}
    for strata in {r["strata"] for r in bins}:
        own = sorted(((r["bin"], r["count"]) for r in bins if r["strata"] == strata), reverse=True)
        m, seen = sum(n for _, n in own), 0
        for b, n in own:
            seen += n
            if 10 ** (-b / BINS_PER_DECADE) <= q * seen / m:
                least[strata] = b
    return least


def scan_secrets(df: DataFrame, *, q: float = 0.01, text_col: str = "text") -> DataFrame:
    """All columns but the text, and ``base_spans`` and ``secrets``: arrays of (start, rank, kind, end), by start and then kind.

    Base kinds are the fixed patterns. A further kind, ``random``, takes runs
    of 20 or more encoded-looking characters that touch no base span. Their
    encoding is inferred, and three tests ask how an ordinary string would come
    to look as random: its chi-squared statistic would be as low by the normal
    approximation, its runs above and below the middle of the alphabet and its
    serial correlation as near to a random string's by the counts of all
    surely ordinary tokens of like length. The three p-values are combined
    (Cauchy), and discoveries are those of Benjamini and Hochberg at rate ``q``
    in each length class. They also have to fit a random string: the combined
    p-values of the same three tests under randomness must be 0.001 or more.

    Positions count code points, ends are exclusive. A null or empty text has
    no secrets; a long one is scanned whole, within one row; repeated rows are
    scanned each; an empty table gives no rows. Rows are never dropped. Columns
    of any name are kept, but two with the names of the results are replaced.
    """
    results = ("base_spans", "secrets")
    others = [c for c in df.columns if c.lower() not in (text_col.lower(), *results)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.concat(*[_spans(text, p, g, least, kind, i) for i, (kind, p, g, least) in enumerate(BASE)]))
    whole = F.struct(F.lit(True).alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    rows = df.select(whole.alias("whole"), spans.alias("base_spans"), _battery(_candidates(text)).alias("tests"))
    rows = Scratch(df.sparkSession, "secrets").cut(rows, "spans")
    runs, serial = usual(rows, "runs"), usual(rows, "serial")
    tokens = rows.select(F.explode("tests").alias("t")).select("t.strata", _bin(F.col("t"), runs, serial).alias("bin"))
    least = thresholds(tokens, q)
    limits = F.array(*[F.lit(least.get(i, MOST_BINS + 1)) for i in range(MOST_CLASSES)])
    random = F.filter(
        F.col("tests"),
        lambda t: t["fits"] & (_bin(t, runs, serial) >= F.element_at(limits, t["strata"] + 1)) & ~F.exists(F.col("base_spans"), lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])),
    )
    random = F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(len(BASE)).alias("rank"), F.lit("random").alias("kind"), t["end"].alias("end"), (t["end"] - t["start"]).alias("measured")))
    return rows.select(*[F.col("whole").getField(f"c{i}").alias(c) for i, c in enumerate(others)], "base_spans", F.array_sort(F.concat("base_spans", random)).alias("secrets"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind, *_ in BASE],
        F.sha2(joined_spans(F.col("base_spans")), 256).alias("base_sha256"),
        joined_spans(F.col("secrets")).alias("spans"),
    )

"""Nearest neighbours by a block matrix join of int8 tiles, with exact distances for what survives."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.scratch import Scratch

#: Vectors of a tile: candidates and queries; queries are taken so many at a time within it.
CANDIDATES, QUERIES, AT_ONCE = 16_384, 4_096, 64


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, end to end, and where each list begins."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _coded(batches):
    """int8 codes of each vector, its scale, the norm of what the codes leave out, and a hash of the vector."""
    for batch in batches:
        flat, at = _matrix(batch.column("v"))
        codes, scales, lost = [], [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            x = flat[a:b]
            scale = np.abs(x).max() / 127
            scale = scale if scale > 0 else 1.0
            c = np.rint(x / scale).astype(np.int8)
            codes.append(c.tobytes()), scales.append(scale), lost.append(np.sqrt(((x - c * scale) ** 2).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("dim"), batch.column("same"), pa.array(codes, pa.binary()), pa.array(scales, pa.float64()), pa.array(lost, pa.float64())],
            names=["id", "dim", "same", "codes", "scale", "lost"],
        )


def _few_of_each(ids: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k + 1 smallest ids of each vector: more of its copies cannot be among a query's nearest."""
    order = np.lexsort((ids, same))
    s = same[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return np.sort(order[nth <= k])


def _tile(k: int):
    """Pairs of one tile whose lower bound does not exceed the k-th smallest upper bound of their query."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=np.int8).reshape(-1, dim)
        ids, asks, same = table.column("id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False).astype(bool), table.column("same").to_numpy()
        scale, lost = table.column("scale").to_numpy(), table.column("lost").to_numpy()
        query, among = np.flatnonzero(asks), np.flatnonzero(~asks)
        among = among[_few_of_each(ids[among], same[among], k)]
        out = ([], [], [], [])
        # products of codes are whole numbers: exact in float32 up to 2^24
        real = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
        candidates = codes[among].astype(real).T
        norm = (codes.astype(np.float64) ** 2).sum(1) * scale**2
        for begin in range(0, len(query) if len(among) else 0, AT_ONCE):
            q = query[begin : begin + AT_ONCE]
            product = (codes[q].astype(real) @ candidates).astype(np.float64)
            distance = np.sqrt(np.maximum(norm[q][:, None] + norm[among][None, :] - 2 * product * scale[q][:, None] * scale[among][None, :], 0))
            error = lost[q][:, None] + lost[among][None, :] + 1e-7 * (np.sqrt(norm[q])[:, None] + np.sqrt(norm[among])[None, :])
            own = ids[q][:, None] == ids[among][None, :]
            upper, lower = np.where(own, np.inf, distance + error), np.where(own, np.inf, distance - error)
            limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(among) >= k else np.full(len(q), np.inf)
            i, j = np.nonzero((lower <= limit[:, None]) & ~own)
            for column, values in zip(out, (ids[q][i], ids[among][j], lower[i, j], upper[i, j]), strict=True):
                column.append(values)
        joined = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "vec_id": pa.array(joined[1].astype(np.int64)), "lower": pa.array(joined[2]), "upper": pa.array(joined[3])})

    return run


def _nearest_of_each(k: int):
    """Rows come sorted by query; distances are recomputed and a heap of k is kept for the query at hand."""

    def run(batches):
        asked, heap = None, []

        def given():
            best = sorted((-d, -i) for d, i in heap)
            rows = [(asked, n + 1, i, d) for n, (d, i) in enumerate(best)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            (x, at), (y, _) = _matrix(batch.column("qv")), _matrix(batch.column("cv"))
            squares, total = (x - y) ** 2, np.zeros(batch.num_rows)
            length = np.diff(at)
            for n in range(length.max() if len(length) else 0):  # in the order of the components
                longer = length > n
                total[longer] += squares[at[:-1][longer] + n]
            for q, i, d in zip(batch.column("query_id").to_pylist(), batch.column("vec_id").to_pylist(), np.sqrt(total).tolist(), strict=True):
                if q != asked:
                    if heap:
                        yield given()
                    asked, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -i))
                else:
                    heapq.heappushpop(heap, (-d, -i))
        if heap:
            yield given()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors nearest to each query by Euclidean distance, never one with the query's own id.

    Vectors become int8 codes with a scale and the norm of what the codes leave
    out. Candidates and queries are dealt into blocks; each pair of blocks is a
    tile and one task's work, and only codes are shipped to it. A tile's
    product of codes gives each distance to within the two norms. Pairs whose
    lower bound exceeds their query's k-th smallest upper bound go, first in
    the tile and then over all tiles. What survives is joined to the original
    vectors, recomputed in double precision and merged by a heap of k for each
    query. So nothing is approximate in the result. Queries times candidates
    are multiplied, but a candidate is shipped once for each 4,096 queries.

    Returns query_id, rank (from 1), vec_id, score. Vectors that are null, zero
    or have null or non-finite components take no part; vectors of different
    lengths are not compared; ties go to the smaller id; fewer than k
    candidates, or an empty table, give fewer rows. Rows with a null id take no
    part. Of rows that repeat an id, the smallest vector stands for all. Extra
    columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = rows.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
        return rows.groupBy("id").agg(F.min("v").alias("v")).withColumns({"dim": F.size("v"), "same": F.xxhash64("v")})

    base, asking = scratch.cut(clean(vectors), "base"), scratch.cut(clean(queries), "asking")
    rows, cols = max(1, -(-base.count() // CANDIDATES)), max(1, -(-asking.count() // QUERIES))
    schema = "id long, dim int, same long, codes binary, scale double, lost double"
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    coded, ask = scratch.cut(base.mapInArrow(_coded, schema), "coded"), scratch.cut(asking.mapInArrow(_coded, schema), "coded")
    candidates = coded.withColumn("asks", F.lit(False)).withColumn("row", F.pmod(F.xxhash64("id"), F.lit(rows))).withColumn("col", spread(cols))
    asked = ask.withColumn("asks", F.lit(True)).withColumn("row", spread(rows)).withColumn("col", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(cols)))
    tiles = candidates.unionByName(asked).groupBy("dim", "row", "col").applyInArrow(_tile(k), "query_id long, vec_id long, lower double, upper double")
    tiles = scratch.cut(tiles, "bounds")
    kth = Window.partitionBy("query_id").orderBy("upper")
    limits = tiles.withColumn("n", F.row_number().over(kth)).where(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.max("upper")).alias("limit"))
    survivors = tiles.join(limits, "query_id").where("limit IS NULL OR lower <= limit").select("query_id", "vec_id")
    survivors = scratch.cut(survivors, "survivors")
    exact = survivors.join(base.select(F.col("id").alias("vec_id"), F.col("v").alias("cv")), "vec_id").join(asking.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    exact = exact.select("query_id", "vec_id", "qv", "cv").repartition("query_id").sortWithinPartitions("query_id")
    return exact.mapInArrow(_nearest_of_each(k), "query_id long, rank int, vec_id long, score double")


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length into buckets of similar length. The best products of a query with the longest
vectors give it a first threshold. Blocks of queries then meet buckets. Which ones is known from a few numbers, before
any vector moves: a bucket whose longest vector cannot reach the threshold of any query of a block is skipped. In the
others the local threshold of the cosine, threshold / (query length x
longest length), chooses the pruning. Where it is low, the bucket's sorted lengths are cut at threshold / query
length. Where it is high, the query's coordinate of largest share confines the same coordinate of every
unit vector that can reach the cosine to a short interval, found by bisection in the bucket's sorted list of that
coordinate. What is left is verified by whole-number products, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

#: Vectors in a bucket and in the seed at most, queries in a block at most, length ratio within a bucket at least.
BUCKET, SEED, BLOCK, RATIO = 2048, 1024, 1024, 0.9
#: From this local cosine threshold on, coordinates prune; below, lengths.
COSINE = 0.6
#: Levels of length to each doubling; that of vectors of no length, and one above all. Lengths are rounded, products are not: SLACK.
LEVELS, LOW, HIGH, SLACK = 4, -(1 << 20), 1 << 20, 1 + 1e-9
HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and x: floor(scale * component) as whole numbers. Rows with a null or non-finite component, or none, go.
    A component beyond 64 bits raises."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))

    def whole(x: F.Column) -> F.Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error(F.lit("a component does not fit a whole number of 64 bits")).cast("long"))

    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole).alias("x"))


_PACKED = "dim int, width int, ids binary, rows binary"


def _pack(ids: np.ndarray, rows: np.ndarray) -> list[pa.Array]:
    """Of vectors with one number of components: that number, bytes of a component, ids and components."""
    top = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    kind = next(t for t in ("<i2", "<i4", "<i8") if top <= np.iinfo(t).max or t == "<i8")
    return [pa.array([rows.shape[1]], pa.int32()), pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([rows.astype(kind).tobytes()], pa.binary())]


def _unpack(width: int, ids: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(rows, f"<i{width}").astype(np.int64).reshape(len(ids), -1)


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, components) of consecutive rows with one number of components."""
    n = pc.list_value_length(batch.column(column)).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), len(n)] if len(n) else [0]
    for a, b in zip(edges, edges[1:]):
        yield a, batch.column(column).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact: in float64 as long as no partial sum can leave the 53 bits, else in whole numbers; raises beyond 64 bits."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    if max(abs(v) for v in exact.ravel().tolist()) >= 2**63:
        raise OverflowError("a product does not fit a whole number of 64 bits")
    return exact.astype(np.int64)


def _best(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query (score descending, id ascending) of flat arrays, without the query itself."""
    keep = queries != ids
    queries, ids, scores = queries[keep], ids[keep], scores[keep]
    order = np.lexsort((ids, -scores, queries))
    queries, ids, scores = queries[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, queries[1:] != queries[:-1]]) if len(queries) else np.zeros(0, int)
    rank = np.arange(len(queries)) - np.repeat(starts, np.diff(np.r_[starts, len(queries)]))
    return queries[rank < k], ids[rank < k], scores[rank < k]


def meet(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a block of queries and a bucket that can be among a query's k best: flat query ids, ids, scores.

    ``least``: what a score must reach, for each query.
    """
    length, q_length = np.sqrt((v.astype(np.float64) ** 2).sum(1)), np.sqrt((q.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    v_ids, v, length = v_ids[order], v[order], length[order]
    slack = SLACK
    alive = np.flatnonzero(q_length * length[0] * slack >= least)
    out = []
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_length * length[0] > 0, least / (q_length * length[0] * slack), -1)[alive]
        by_length, by_coordinate = alive[~(cosine >= COSINE)], alive[cosine >= COSINE]
        if len(by_length):
            # Of the queries together: the bucket up to the last vector that any of them can use; the rest by each one's cut.
            needed = np.where(least[by_length] > 0, least[by_length] / (q_length[by_length] * slack), -1)
            cut = np.searchsorted(-length, -needed, "right")
            scores = _products(q[by_length], v[: cut.max()])
            i, j = np.nonzero((np.arange(cut.max()) < cut[:, None]) & (scores >= least[by_length][:, None]))
            out.append((q_ids[by_length][i], v_ids[j], scores[i, j]))
        if len(by_coordinate):
            unit = v / np.where(length > 0, length, 1)[:, None]
            axis = np.abs(q[by_coordinate]).argmax(1)
            lists = {a: np.argsort(unit[:, a], kind="stable") for a in set(axis.tolist())}
            for i, a in zip(by_coordinate.tolist(), axis.tolist()):
                # With c the query's unit coordinate: cosine <= c u + sqrt(1 - c^2) sqrt(1 - u^2) bounds u on both sides.
                c, t = q[i, a] / q_length[i], min(1.0, least[i] / (q_length[i] * length[0] * slack))
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - c * c)))
                low, high = (t * c - spread if t > -c else -1.0), (t * c + spread if t < c or c < 0 else 1.0)
                low, high = (-1.0 if -c >= t else low), (1.0 if c >= t else high)
                u = unit[lists[a], a]
                mine = lists[a][np.searchsorted(u, low - 1e-9) : np.searchsorted(u, high + 1e-9, "right")]
                mine = mine[length[mine] * q_length[i] * slack >= least[i]]
                if len(mine):
                    scores = _products(q[i : i + 1], v[mine])[0]
                    ok = scores >= least[i]
                    out.append((np.full(ok.sum(), q_ids[i]), v_ids[mine[ok]], scores[ok]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return _best(*(np.concatenate(x) for x in zip(*out)), k)


def top_products(vectors: DataFrame, is_query: F.Column | None = None, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` best products of each query vector with all other vectors: query_id, rank, vec_id, score.

    Components become floor(scale * component). Ties go to the smaller vec_id. Null vectors or ids, and vectors with
    null or non-finite components, take no part; a query without other vectors has no row; empty tables give an
    empty result; repeated rows of one id count as one vector each and are never partners of their own id. Only
    vectors with as many components meet (all products of vectors without components are 0). Products are exact;
    one that 64 bits cannot hold raises.
    """
    spark = vectors.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = quantised(vectors, id_col, vector_col, scale)
    with_length = q.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).withColumn("dim", F.size("x"))

    def numbered() -> Iterator[int]:
        from pyspark import TaskContext

        return iter(range(TaskContext.get().partitionId() << 33, 1 << 62))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of components and length; a bucket ends at BUCKET vectors or where lengths fall under RATIO of its first."""
        number = numbered()

        def cut(held, all_of_them):
            while len(held[0]) > (0 if all_of_them else BUCKET):
                n = max(1, min(BUCKET, int(np.searchsorted(-held[2], -RATIO * held[2][0], "right"))))
                if all_of_them and len(held[0]) - n < BUCKET // 8:  # the few that are left join the last bucket
                    n = len(held[0])
                ids, rows, length = (x[:n] for x in held)
                level = LOW if length[0] <= 0 else int(np.floor(LEVELS * np.log2(length[0])))
                yield pa.RecordBatch.from_arrays([pa.array([next(number)]), pa.array([float(length.max())]), pa.array([level], pa.int32()), *_pack(ids, rows)], names=["bucket", "longest", "level", "dim", "width", "ids", "rows"])
                held = tuple(x[n:] for x in held)
            return held

        held = None
        for batch in batches:
            for at, rows in _matrices(batch, "x"):
                new = batch.column("vec_id").to_numpy()[at : at + len(rows)], rows, batch.column("length").to_numpy()[at : at + len(rows)]
                if held is not None and held[1].shape[1] != rows.shape[1]:
                    yield from cut(held, True)
                    held = None
                held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
                held = yield from cut(held, False)
        if held is not None:
            yield from cut(held, True)

    sorted_ = with_length.repartitionByRange(n_parts, "dim", F.col("length").desc(), F.xxhash64("vec_id")).sortWithinPartitions("dim", F.col("length").desc())
    bucket_rows = written(sorted_.mapInArrow(buckets, f"bucket long, longest double, level int, {_PACKED}"), "norm-buckets")

    # The first thresholds come from the SEED longest vectors: a fixed number, sent to all tasks.
    seed = with_length.orderBy(F.col("length").desc(), "vec_id").limit(SEED).select("vec_id", "x").collect()
    by_dim: dict[int, list] = {}
    for r in seed:
        by_dim.setdefault(len(r["x"]), []).append(r)
    seeds = {d: (np.array([r["vec_id"] for r in rows], np.int64), np.array([r["x"] for r in rows], np.int64).reshape(len(rows), d)) for d, rows in by_dim.items()}
    lowest = np.iinfo(np.int64).min

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbered()
        for batch in batches:
            every = batch.column("vec_id").to_numpy()
            for first, matrix in _matrices(batch, "x"):
                for at in range(0, len(matrix), BLOCK):
                    rows = matrix[at : at + BLOCK]
                    ids = every[first + at : first + at + len(rows)]
                    least = np.full(len(ids), lowest)
                    seed_ids, seed_rows = seeds.get(rows.shape[1], (np.zeros(0, np.int64), rows[:0]))
                    scores = _products(rows, seed_rows) if len(seed_ids) else np.zeros((len(ids), 0), np.int64)
                    scores[ids[:, None] == seed_ids[None, :]] = lowest
                    if scores.shape[1] >= k:
                        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                    length = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
                    with np.errstate(divide="ignore"):
                        needed = float(np.where(least > 0, least / (length * SLACK), -1.0).min())
                    level = LOW if needed <= 0 else HIGH if needed == np.inf else int(np.floor(LEVELS * np.log2(needed)))
                    yield pa.RecordBatch.from_arrays([pa.array([next(number)]), pa.array([needed]), pa.array([level], pa.int32()), pa.array([least.astype("<i8").tobytes()], pa.binary()), *_pack(ids, rows)], names=["block", "needed", "from_level", "least", "dim", "width", "ids", "rows"])

    chosen = q.filter(is_query if is_query is not None else F.col("vec_id") % 50 == 0).withColumn("dim", F.size("x"))
    block_rows = written(chosen.repartition(n_parts, F.xxhash64("vec_id")).sortWithinPartitions("dim").mapInArrow(blocks, f"block long, needed double, from_level int, least binary, {_PACKED}"), "query-blocks")
    block_rows = block_rows.select("block", "needed", "from_level", "least", "dim", F.struct("width", "ids", "rows").alias("q"))

    # Blocks and buckets meet by number first, on equal levels of length; vectors move only for pairs that are left.
    levels = [r["level"] for r in bucket_rows.select("level").distinct().collect()]  # LEVELS to each doubling of the length
    wanted = block_rows.select("block", "needed", "dim", F.explode(F.filter(F.array(*map(F.lit, sorted(levels))).cast("array<int>"), lambda x: x >= F.col("from_level"))).alias("level"))
    pairs = wanted.join(bucket_rows.select("bucket", "longest", "level", "dim"), ["level", "dim"]).filter("longest >= needed").select("block", "bucket")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mine, theirs, least = (batch.column(c)[i].as_py() for c in ("q", "v", "least"))
                found = meet(*_unpack(mine["width"], mine["ids"], mine["rows"]), np.frombuffer(least, "<i8"), *_unpack(theirs["width"], theirs["ids"], theirs["rows"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    met = pairs.join(block_rows.select("block", "q", "least"), "block").join(bucket_rows.select("bucket", F.struct("width", "ids", "rows").alias("v")), "bucket")
    hits = met.select("q", "least", "v").mapInArrow(verify, HITS)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read_table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

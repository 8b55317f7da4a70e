"""Exact top-k inner products with bounds from a pivot table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from surfparc.llm.common import small, table
from surfparc.session import cut

PIVOTS = 24
BLOCK = 4096
QUERIES = 4096
STRIPE = 256
FIRST = 64
K = 5
LOWEST = -(2**62)
MEASURED = "id long, v array<long>, n long, norm long, far array<double>, home int"
ASKED = f"{MEASURED}, name string, ask int, floor long, cells array<int>"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, n): the rows with all components finite, scaled to floor(256 x); ``n`` rows share id and vector."""
    whole = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    return vectors.filter(whole).select(F.col(key).alias("id"), scaled.alias("v")).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))


def stacked(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to a common width."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    if len(values):
        out[np.arange(width) < size[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows, in floating point where no sum can pass 2**53."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**52 else a @ b.T


def with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds each vector's squared length, its distances to the pivots and the number of the nearest one."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = stacked(batch.column(1), pivots.shape[1])
            norm = (v * v).sum(1)
            apart = np.sqrt((norm[:, None] + (pivots * pivots).sum(1) - 2 * products(v, pivots)).astype(float))
            far = pa.FixedSizeListArray.from_arrays(pa.array(apart.ravel()), len(pivots)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(norm), far, pa.array(apart.argmin(1).astype(np.int32))], ["id", "v", "n", "norm", "far", "home"])

    return rows.select("id", "v", "n").mapInArrow(measure, MEASURED)


class Vectors:
    """Rows of one block as arrays."""

    def __init__(self, t: pa.Table, width: int) -> None:
        self.id, self.n, self.norm = (t[c].to_numpy() for c in ("id", "n", "norm"))
        self.v = stacked(t["v"], width)
        far = t["far"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.far = far.reshape(t.num_rows, len(far) // max(t.num_rows, 1))


def slack(norms: np.ndarray) -> np.ndarray:
    """More than rounding can take off a bound."""
    return 1e-9 * norms + 1e-3


def best_of_block(q: Vectors, x: Vectors, k: int, floor: np.ndarray) -> list[np.ndarray]:
    """Query numbers, candidate ids, scores and row counts of each query's ``k`` best in a block, none below its ``floor``.

    A candidate's distance to a query is at least the largest difference of their
    distances to a pivot, which bounds the inner product from above. Candidates
    whose bound reaches the floor are scored in the order of that bound until it
    falls below the k-th score.
    """
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 4]
    for a in range(0, len(q.id), STRIPE):
        z = slice(a, a + STRIPE)
        least = np.zeros((len(q.id[z]), len(x.id)))
        for p in range(q.far.shape[1]):
            np.maximum(least, np.abs(q.far[z, p, None] - x.far[None, :, p]), out=least)
        norms = (q.norm[z, None] + x.norm[None, :]).astype(float)
        bound = (norms - least * least) / 2 + slack(norms)
        for i in range(len(bound)):
            ask, at = a + i, np.flatnonzero(bound[i] >= floor[a + i])
            own = at[x.id[at] == q.id[ask]]
            own = own[(x.v[own] == q.v[ask]).all(1)]  # the query's own row is one of these
            at = at[~np.isin(at, own[x.n[own] == 1])]
            at = at[np.argsort(-bound[i, at], kind="stable")]
            score, pick, lo, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST
            while lo < len(at) and (len(score) < k or bound[i, at[lo]] >= score[k - 1]):
                new = at[lo : lo + step]
                score, pick = np.append(score, products(q.v[ask : ask + 1], x.v[new])[0]), np.append(pick, new)
                top = np.lexsort((x.id[pick], -score))[:k]
                score, pick = score[top], pick[top]
                lo, step = lo + step, 2 * step
            high = score >= floor[ask]
            pick, score = pick[high], score[high]
            found.append([np.full(len(pick), ask), x.id[pick], score, x.n[pick] - np.isin(pick, own)])
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def cell_limits(rows: DataFrame, pivots: int) -> dict[int, tuple[int, int, np.ndarray, np.ndarray]]:
    """Per nearest pivot, of which there are ``pivots``: rows, longest squared length, least and largest distance to each pivot."""
    far = [F.col("far")[p] for p in range(pivots)]
    found = rows.groupBy("home").agg(F.count(F.lit(1)), F.max("norm"), F.array(*[F.min(f) for f in far]), F.array(*[F.max(f) for f in far])).collect()
    return {home: (n, norm, np.array(lo), np.array(hi)) for home, n, norm, lo, hi in found}


def reached_cells(q: Vectors, floor: np.ndarray, cells: dict) -> list[list[int]]:
    """For each query the cells that may hold a candidate whose score reaches its floor."""
    out: list[list[int]] = [[] for _ in floor]
    for home, (_, norm, lo, hi) in sorted(cells.items()):
        least = np.maximum(np.maximum(q.far - hi, lo - q.far), 0).max(1)
        norms = (q.norm + norm).astype(float)
        for i in np.flatnonzero((norms - least * least) / 2 + slack(norms) >= floor):
            out[i].append(home)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """Each query's ``k`` highest integer inner products among all other rows of ``vectors``.

    Rows belong to the cell of their nearest pivot; cells are dealt into blocks by
    a hash. A first round meets each block of queries with one block of their own
    cell: the k-th score there is a floor. The pivot distances of a cell (least
    and largest to each pivot) rule out cells whose bound lies below the floor;
    queries go to the blocks of the others, and candidates to the blocks of
    queries that any such query is in. Each such pair of blocks is a task of
    bounded size (``best_of_block``), whose ``k`` best go on to a ranking per
    query. Results are exact; only the pivots, as many rows as ``pivots`` says,
    and their cells' limits pass through the driver.

    Returns query_id, rank (from 1), vec_id, score; equal scores go to the
    smaller id. Ids that are null, and vectors that are null or hold null or
    non-finite components, take no part. Every other row is a candidate, also
    those that repeat an id or a whole row; only the query's own row is left
    out, one of those that equal it in id and vector. A query row that repeats
    an id gives ``k`` rows of its own. Shorter vectors are filled with zeros.
    With fewer than ``k`` others all are returned; empty tables give no rows.
    """
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    first = rows.orderBy(F.xxhash64("id", "v"), "id", "v").limit(pivots).select("v").toPandas()["v"]
    widest = rows.select("v").unionByName(asked.select("v")).agg(F.max(F.size("v"))).first()[0]
    width = max(widest or 0, 1)
    table_of = np.zeros((max(len(first), 1), width), np.int64)
    for at, v in enumerate(first):
        table_of[at, : len(v)] = v
    rows = cut(with_pivots(rows, table_of))
    asked = cut(with_pivots(asked, table_of).withColumn("name", F.md5(F.array_join("v", ",").cast("binary"))))
    cells = cell_limits(rows, len(table_of))
    asking = {home: n for home, n in asked.groupBy("home").count().collect()}
    per_cell = lambda n, size: F.array(*[F.lit(-(-n.get(h, 0) // size) or 1) for h in range(len(table_of))])
    blocks = per_cell({h: c[0] for h, c in cells.items()}, BLOCK)
    asks = per_cell(asking, QUERIES)
    dealt = lambda n: F.pmod(F.xxhash64("id", "v"), n[F.col("home")]).cast("int")
    rows = rows.withColumn("block", dealt(blocks))
    asked = asked.withColumn("ask", dealt(asks))

    asked_kind = to_arrow_schema(StructType.fromDDL(ASKED))

    def floors(left: pa.Table, right: pa.Table) -> pa.Table:
        q = Vectors(left, width)
        floor = np.full(len(q.id), LOWEST)
        if not left.num_rows:
            return pa.table([pa.array([], f.type) for f in asked_kind], schema=asked_kind)
        if right.num_rows:
            ask, _, score, _ = best_of_block(q, Vectors(right, width), k, floor)
            full = np.bincount(ask, minlength=len(floor)) == k
            lowest = np.full(len(floor), np.iinfo(np.int64).max)
            np.minimum.at(lowest, ask, score)
            floor[full] = lowest[full]
        cols = [left[c] for c in ("id", "v", "n", "norm", "far", "home", "name", "ask")]
        return pa.table([*cols, pa.array(floor), pa.array(reached_cells(q, floor, cells), pa.list_(pa.int32()))], names=[c.split()[0] for c in ASKED.split(", ")])

    one = asked.withColumn("block", F.pmod("ask", blocks[F.col("home")]))
    steps = F.when(F.col("block") < asks[F.col("home")], F.sequence(F.col("block"), asks[F.col("home")] - 1, blocks[F.col("home")]))
    met = rows.withColumn("ask", F.explode(steps))
    wanted = cut(one.groupBy("home", "ask").cogroup(met.groupBy("home", "ask")).applyInArrow(floors, ASKED))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["id", "name", "m", "vec_id", "score", "copies"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), *[pa.int64()] * 4)], names=names)
        ask, *found = best_of_block(Vectors(left, width), Vectors(right, width), k, left["floor"].to_numpy())
        at = pa.array(ask)
        return pa.table([left["id"].take(at), left["name"].take(at), left["n"].take(at), *[pa.array(c, pa.int64()) for c in found]], names=names)

    # Queries on a line, cell after cell, cut into as few groups as their number needs.
    total = sum(asking.values())
    before = F.array(*[F.lit(sum(n for h, n in asking.items() if h < home)).cast("long") for home in range(len(table_of))])
    in_cell = F.array(*[F.lit(asking.get(home, 0)).cast("long") for home in range(len(table_of))])
    place = before[F.col("home")] + F.pmod(F.xxhash64("id", "v"), in_cell[F.col("home")])
    group = F.floor(place * F.lit(-(-total // QUERIES)) / F.lit(max(total, 1))).cast("int")
    spread = wanted.withColumn("ask", group).withColumn("cell", F.explode("cells"))
    pairs = small(cut(spread.select("ask", "cell").distinct()))
    sought = spread.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)))
    offered = rows.withColumnRenamed("home", "cell").join(pairs, "cell")
    by = ["ask", "cell", "block"]
    near = sought.groupBy(*by).cogroup(offered.groupBy(*by)).applyInArrow(meet, "id long, name string, m long, vec_id long, score long, copies long")
    best = W.partitionBy("id", "name").orderBy(F.desc("score"), "vec_id")
    kept = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    each = kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    ranked = each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    again = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return again.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT own, vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM e),
s AS (SELECT q.own, q.vec_id AS query_id, c.own AS other, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM p q JOIN p c ON q.d = c.d AND q.own <> c.own WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

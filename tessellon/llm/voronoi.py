"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors are cut into cells by their nearest pivot (k-means over a bounded sample). Each cell's summary is its count,
its radius and its k+1 members nearest the pivot; the summaries are bounded by the number of pivots and reach every
task. A query's k-th best score over all summary members is a lower bound of its true k-th best; for a member x of a cell
with pivot p, <q,x> <= <q,p> + |q| |x-p|, so a query group needs of a cell only the members at least so far from the
pivot that the bound is reached, and of most cells none. Those members alone are sent to the group, cut into blocks of bounded
size, and every (group, block) pair is solved by one exact integer product. The best k of a query's blocks are its answer.

Defined results: vectors that are null or hold a null or non-finite component, and rows with a null id, take no part;
shorter vectors count as padded with zeros; components beyond 64 bits and scores beyond 64 bits are cut to the range;
equal scores go to the smaller id; a repeated row is a candidate as often as it stands there and asks once (rows of one id with
different vectors: with the one whose packed bytes are least); queries
with no other vector return no rows; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm.common import materialise, small_or_whole

SCALE, K, EVERY = 1024, 10, 100
#: Vectors that the pivots are fitted on (up to twice as many), most pivots, most rows of a block and of a query group.
SAMPLE, MOST_PIVOTS, BLOCK, GROUP = 2000, 256, 65_536, 4096
LONG_MAX = (1 << 63) - 1


def _whole(values, scale: int):
    """floor(scale * x) of doubles as 64-bit integers."""
    import numpy as np

    v = np.floor(np.asarray(values, np.float64) * scale)
    return np.where(v >= 2.0**63, LONG_MAX, np.where(v < -(2.0**63), -LONG_MAX, np.where(np.abs(v) < 2.0**63, v, 0).astype(np.int64)))


def _scores(q, x):
    """Exact inner products of integer rows."""
    import numpy as np

    top = int(np.abs(q).max(initial=0).astype(object)) * int(np.abs(x).max(initial=0).astype(object)) * max(1, q.shape[1])
    if top < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if top < 1 << 63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    s = q.astype(object) @ x.astype(object).T
    return np.clip(s, -LONG_MAX, LONG_MAX).astype(np.int64)


def _best(q, q_ids, x, x_ids, k: int, chunk: int = 64):
    """(query position, id, score) of each query's k best among x, not counting the query's own id."""
    import numpy as np

    rows = []
    for lo in range(0, len(q), chunk):
        s = _scores(q[lo : lo + chunk], x)
        for i in range(len(s)):
            row = s[i]
            ok = x_ids != q_ids[lo + i]
            n = int(ok.sum())
            if n > k:
                # everything that scores at least the k-th best, ties included, then by score and id
                edge = np.partition(row[ok], n - k)[n - k]
                at = np.flatnonzero(ok & (row >= edge))
            else:
                at = np.flatnonzero(ok)
            at = at[np.lexsort((x_ids[at], -row[at]))][:k]
            rows += [(lo + i, int(x_ids[j]), int(row[j])) for j in at]
    return rows


def pivots_of(sample, most: int, rounds: int = 8):
    """At most so many pivots: k-means over the sample from evenly spaced rows."""
    import numpy as np

    x = np.unique(sample.astype(np.float64), axis=0)
    c = x[np.linspace(0, len(x) - 1, min(most, len(x))).astype(int)]
    for _ in range(rounds):
        near = _nearest(x, c)[0]
        for i in range(len(c)):
            if (own := near == i).any():
                c[i] = x[own].mean(0)
    return np.unique(c, axis=0)


def _nearest(x, c):
    import numpy as np

    d = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))
    near = d.argmin(1)
    return near, np.sqrt(((x - c[near]) ** 2).sum(1))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK, group: int = GROUP, most_pivots: int = MOST_PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) whose id is divisible by ``every``."""
    import numpy as np

    spark = vectors.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", bad))
    told = rows.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("dims"), F.max(F.greatest(F.array_max("e"), -F.array_min("e"))).alias("top")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not told["n"]:
        return spark.createDataFrame([], schema)
    n, dims, top = told["n"], max(1, told["dims"]), (told["top"] or 0.0) * scale + 1
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"

    def matrix(col):
        """Rows of an arrow list column, padded."""
        flat, size = np.asarray(col.flatten()), np.asarray(col.value_lengths())
        if (size == dims).all():
            return _whole(flat, scale).reshape(-1, dims)
        out, at = np.zeros((len(size), dims), np.int64), 0
        for i, s in enumerate(size.tolist()):
            out[i, :s] = _whole(flat[at : at + s], scale)
            at += s
        return out

    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // sample))) == 0).limit(4 * sample).toArrow() if n else None
    seed = matrix(picked["e"].combine_chunks()) if len(picked) else np.zeros((1, dims), np.int64)
    c = pivots_of(seed, min(most_pivots, max(4, math.isqrt(n) // 8)))

    def assigned(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            near, far = _nearest(x.astype(np.float64), c)
            flat = np.ascontiguousarray(x.astype(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(far), pa.array([r.tobytes() for r in flat], pa.binary())], names=["vec_id", "cell", "far", "v"])

    cells = materialise(rows.mapInArrow(assigned, "vec_id bigint, cell int, far double, v binary"), "voronoi")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    summary = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.count_if(is_query).alias("q")).collect()}
    near_pivot = Window.partitionBy("cell").orderBy("far", "vec_id")
    members = cells.withColumn("i", F.row_number().over(near_pivot)).where(F.col("i") <= k + 1).select("vec_id", "v").toArrow()
    unpack = lambda col: np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, dims)
    m_ids, m_vec = np.asarray(members["vec_id"].combine_chunks()), unpack(members["v"]).astype(np.float64)

    blocks = {cell: math.ceil(r["n"] / block) for cell, r in summary.items()}
    # query groups: neighbouring cells together up to the size of a group, large cells in several
    groups, at, room = {}, 0, group
    for cell in sorted(summary):
        q = summary[cell]["q"]
        if q > room:
            at, room = at + 1, group
        split = max(1, math.ceil(q / group))
        groups[cell] = (at, split)
        if split > 1:
            at, room = at + split, group
        else:
            room -= q
    radius = np.array([summary[i]["radius"] if i in summary else -np.inf for i in range(len(c))])
    bits = len(c)

    def asked(batches):
        """Each query with its group, and for each cell how far from the pivot a member must be to matter (null: none does)."""
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            ids, q = np.asarray(b.column(0)), unpack(b.column(2)).astype(np.float64)
            s = np.where(ids[:, None] == m_ids[None, :], -np.inf, q @ m_vec.T)
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(q), -np.inf)
            size = np.sqrt((q * q).sum(1))
            to_pivot = q @ c.T
            slack = 1e-9 * (np.abs(to_pivot) + size[:, None] * np.maximum(radius, 0)[None, :] + 1) + 1e-6
            need = to_pivot + size[:, None] * radius[None, :] + slack >= least[:, None]
            with np.errstate(invalid="ignore", divide="ignore"):
                start = np.where(size[:, None] > 0, (least[:, None] - to_pivot - slack) / np.maximum(size[:, None], 1e-300), 0.0)
            start = np.where(np.isfinite(start), start, -1.0)
            out = [[float(start[i, j]) if need[i, j] and np.isfinite(radius[j]) else None for j in range(bits)] for i in range(len(q))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.float64()))], names=["query_id", "grp", "q", "start"])

    base, split = (F.create_map(*(F.lit(x) for cell, g in groups.items() for x in (cell, g[i]))) for i in (0, 1))
    grp = base[F.col("cell")] + F.pmod(F.xxhash64("vec_id"), split[F.col("cell")]).cast("int")
    queries = cells.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("x")).select("vec_id", "x.v", "x.cell").select("vec_id", grp.alias("grp"), "v").mapInArrow(asked, "query_id bigint, grp int, q binary, start array<double>")
    queries = materialise(queries, "voronoi-queries")
    n_blocks = F.create_map(*(F.lit(x) for x in (y for item in blocks.items() for y in item)))
    needs = queries.select("grp", F.posexplode("start").alias("cell", "start")).where("start is not null").groupBy("grp", "cell").agg(F.min("start").alias("start"))
    needs = materialise(needs.withColumn("part", F.explode(F.sequence(F.lit(0), n_blocks[F.col("cell")] - 1))), "voronoi-needs")
    data = cells.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_blocks[F.col("cell")]).cast("int"))
    sent = data.join(small_or_whole(needs, 40), ["cell", "part"]).where("far >= start").select("grp", "cell", "part", "vec_id", "v")
    asks = queries.join(small_or_whole(needs.select("grp", "cell", "part"), 24), "grp").select("grp", "cell", "part", "query_id", "q")

    def solve(q, x):
        import pyarrow as pa

        if not len(q) or not len(x):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q_ids = np.asarray(q["query_id"].combine_chunks())
        got = _best(unpack(q["q"]), q_ids, unpack(x["v"]), np.asarray(x["vec_id"].combine_chunks()), k)
        return pa.table({"query_id": pa.array([int(q_ids[i]) for i, _, _ in got], pa.int64()), "vec_id": pa.array([j for _, j, _ in got], pa.int64()), "score": pa.array([s for _, _, s in got], pa.int64())})

    keys = ["grp", "cell", "part"]
    found = asks.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
  FROM v q, v x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

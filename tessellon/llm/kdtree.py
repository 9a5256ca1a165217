"""Approximate search by inner product: stable projections to a few dimensions, a kd-tree over them, a chi-square stopping test.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest length, a query gets 0 there; then the largest
inner product is the smallest distance. A Gaussian matrix projects to DIMS dimensions; for a vector at distance d the
squared projected distance is d^2 times a chi-square variable. A kd-tree splits the projected space into cells (its
upper levels, fitted on a bounded sample) and each cell into leaves. A query takes leaves in the order of their projected
distance and verifies their vectors with the exact product; it stops when the next leaf, or cell, is so far that a
vector nearer than the k-th found would have shown up before with probability CERTAIN: chi2(far^2 / kth^2) >= CERTAIN. A
query searches its home cell first; the distance found there tells which other cells it has to go to.

Equal vectors are one class: of its ids the k + 1 smallest are kept, as no answer can hold more of them, and queries with
one vector search once. Cells beyond PART rows are dealt into parts, queries into groups of bounded size, so no task
gets more than a part and a group. There the queries that have come to one leaf are verified by one matrix product. Every row is in the index and no number of candidates is fixed: only the test ends a search.

Defined results: vectors that are null, zero or hold a null or non-finite component, and rows with a null id, take no part;
shorter vectors count as padded with zeros; equal scores go to the smaller id; repeated rows of one id and vector count
once; an id with several vectors is a candidate with each and asks with that whose packed bytes are least; queries with no
other vector return no rows; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm.common import materialise
from tessellon.llm.quality import chi2_quantile

K, EVERY = 20, 20
#: Projected dimensions, and how sure a search is that it has seen what is nearer.
DIMS, CERTAIN, SEED = 8, 0.975, 17
#: Projected vectors that the upper tree is fitted on (up to twice as many), most cells, rows of a cell while there are fewer, most rows of a part, of a leaf, and of a query group.
SAMPLE, MOST_CELLS, CELL, PART, LEAF, GROUP = 16_384, 256, 2048, 65_536, 256, 4096


def splits(sample, cells: int):
    """Dimension and value of each inner node of the upper tree, in heap order: the widest dimension is cut at its median."""
    import numpy as np

    inner = (1 << max(0, math.ceil(math.log2(max(1, cells))))) - 1
    dim, value, own = np.zeros(inner, np.int64), np.zeros(inner), {0: sample}
    for i in range(inner):
        x = own.pop(i)
        if len(x):
            dim[i] = np.argmax(np.ptp(x, axis=0))
            value[i] = np.median(x[:, dim[i]])
        right = x[:, dim[i]] > value[i]
        own[2 * i + 1], own[2 * i + 2] = x[~right], x[right]
    return dim, value


def cell_of(points, dim, value):
    import numpy as np

    node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
    for _ in range((len(dim) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[rows, dim[node]] > value[node])
    return node - len(dim)


class Tree:
    """kd-tree over the projected points of a part; leaves hold at most LEAF points, or points that are all equal."""

    def __init__(self, points, leaf: int = LEAF):
        import numpy as np

        self.order, self.boxes = np.arange(len(points)), []
        todo = [(0, len(points))] if len(points) else []
        while todo:
            lo, hi = todo.pop()
            own = points[self.order[lo:hi]]
            low, high = own.min(0), own.max(0)
            wide = int(np.argmax(high - low))
            if hi - lo <= leaf or high[wide] == low[wide]:
                self.boxes.append((low, high, lo, hi))
                continue
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, wide], mid)]
            todo += [(lo + mid, hi), (lo, lo + mid)]

    def members(self, leaf: int):
        """Positions of a leaf's points."""
        return self.order[slice(*self.boxes[leaf][2:])]

    def away(self, q):
        """Squared distance of each query to each leaf's box."""
        import numpy as np

        out = np.empty((len(q), len(self.boxes)))
        for i, (low, high, _, _) in enumerate(self.boxes):
            gap = q - np.clip(q, low, high)
            out[:, i] = np.einsum("ij,ij->i", gap, gap)
        return out

    def leaves(self, q, far):
        """(squared distance, positions of the points) of leaves, nearest first, while they are nearer than far() says."""
        import numpy as np

        away = self.away(q[None])[0]
        for leaf in np.argsort(away, kind="stable").tolist():
            if away[leaf] > far():
                return
            yield float(away[leaf]), self.members(leaf)


def _search(tree: Tree, vectors, first, q, p, base, bound, k: int, chi: float, slack: float):
    """Positions and scores of each query's k nearest verified vectors with at least its bound's score, by score and first id.

    Each query takes leaves nearest first, as its own stopping test says; the queries that are at one leaf in a step
    are verified there by one matrix product.
    """
    import numpy as np

    n = len(q)
    away = tree.away(p)
    turn = np.argsort(away, axis=1, kind="stable")
    best, top = np.array(bound, float), np.full((n, k), -np.inf)
    who, at, score, live = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], np.arange(n)
    for step in range(len(tree.boxes)):
        # a query's leaves lie ever farther and its best only grows, so one that stops has stopped for good
        live = live[away[live, turn[live, step]] <= chi * np.maximum(0.0, base[live] - 2 * best[live]) + slack]
        if not len(live):
            break
        leaf_of = turn[live, step]
        for leaf in np.unique(leaf_of).tolist():
            own, rows = live[leaf_of == leaf], tree.members(leaf)
            got = q[own] @ vectors[rows].T
            better = got.max(1) > best[own]
            if better.any():
                mine = own[better]
                top[mine] = np.partition(np.concatenate([top[mine], got[better]], axis=1), -k, axis=1)[:, -k:]
                best[mine] = np.maximum(best[mine], top[mine].min(1))
            # rounding may differ between products, so what is that near the edge stays
            i, j = np.nonzero(got >= best[own][:, None] - slack)
            who.append(own[i])
            at.append(rows[j])
            score.append(got[i, j])
    who, at, score = map(np.concatenate, (who, at, score))
    stays = score >= best[who] - slack
    who, at = who[stays], at[stays]
    # one way of summing for all, so that equal vectors and repeated runs give equal scores
    score = np.concatenate([np.zeros(0), *((vectors[at[i : i + 8192]] * q[who[i : i + 8192]]).sum(1) for i in range(0, len(at), 8192))])
    order = np.lexsort((first[at], -score, who))
    who, at, score = who[order], at[order], score[order]
    ends = np.searchsorted(who, np.arange(n + 1))
    return [(at[lo : min(hi, lo + k)], score[lo : min(hi, lo + k)]) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, dims: int = DIMS, certain: float = CERTAIN, cell_rows: int = CELL, part_rows: int = PART, group: int = GROUP, sample: int = SAMPLE, most_cells: int = MOST_CELLS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) whose id is divisible by ``every``."""
    import numpy as np

    spark = vectors.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", bad)).where(F.exists("e", lambda x: x != 0))
    told = rows.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("wide"), F.max(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not told["n"]:
        return spark.createDataFrame([], schema)
    wide, top, keep = told["wide"], told["top"], k + 1
    matrix = np.random.default_rng(SEED).standard_normal((wide + 1, dims))
    chi, slack = chi2_quantile(1 - certain, dims), 1e-9 * (top + 1e-300)
    unpack = lambda column, width: np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            size = np.asarray(b.column(1).value_lengths())
            x = np.zeros((len(size), wide))
            x[np.arange(wide) < size[:, None]] = np.asarray(b.column(1).flatten())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x + 0.0], pa.binary())], names=["vec_id", "v"])

    def projected(batches):
        import pyarrow as pa

        for b in batches:
            x = unpack(b.column(0), wide)
            p = np.c_[x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))] @ matrix
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(p), pa.list_(pa.float64()))], names=["v", "ids", "p"])

    flat = materialise(rows.mapInArrow(packed, "vec_id bigint, v binary").distinct(), "kd-vectors")
    least = Window.partitionBy("v").orderBy("vec_id")
    classes = flat.withColumn("i", F.row_number().over(least)).where(F.col("i") <= keep).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialise(classes.mapInArrow(projected, "v binary, ids array<bigint>, p array<double>"), "kd-classes")
    n = classes.count()
    seen = classes.where(F.pmod(F.xxhash64("v"), F.lit(max(1, n // sample))) == 0).limit(2 * sample).select("p").toArrow()
    dim, value = splits(np.asarray(seen["p"].combine_chunks().flatten()).reshape(-1, dims), min(most_cells, -(-n // cell_rows)))

    def assigned(batches):
        import pyarrow as pa

        for b in batches:
            p = np.asarray(b.column(2).flatten()).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of(p, dim, value), pa.int32())], names=["v", "ids", "p", "cell"])

    cells = materialise(classes.mapInArrow(assigned, "v binary, ids array<bigint>, p array<double>, cell int"), "kd-cells")
    edge = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
    stat = cells.groupBy("cell").agg(F.count("*").alias("n"), *edge).orderBy("cell").collect()  # a row for each of at most most_cells cells
    known, low, high = [r["cell"] for r in stat], np.array([[r[f"lo{i}"] for i in range(dims)] for r in stat]), np.array([[r[f"hi{i}"] for i in range(dims)] for r in stat])
    by_cell = lambda values: F.create_map(*(F.lit(x) for c, v in values.items() for x in (c, v)))[F.col("cell")]
    n_parts = by_cell({r["cell"]: math.ceil(r["n"] / part_rows) for r in stat})
    part_of = F.pmod(F.xxhash64("v"), n_parts).cast("int")
    data = cells.withColumn("part", part_of)

    def boxes(p):
        """Squared distance of each row to each cell's box."""
        gap = p[:, None, :] - np.clip(p[:, None, :], low, high)
        return (gap * gap).sum(2)

    def homes(batches):
        import pyarrow as pa

        for b in batches:
            x = unpack(b.column(0), wide)
            p = np.c_[x, np.zeros(len(x))] @ matrix
            home = np.array(known)[boxes(p).argmin(1)] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in p], pa.binary()), pa.array(home, pa.int32()), pa.array(np.full(len(x), -np.inf))], names=["v", "q", "cell", "bound"])

    def solve(ask, own):
        import pyarrow as pa

        out = []
        if ask.num_rows:
            x, p, bound = unpack(ask["v"], wide), unpack(ask["q"], dims), np.asarray(ask["bound"])
            points = np.asarray(own["p"].combine_chunks().flatten()).reshape(-1, dims) if own.num_rows else np.zeros((0, dims))
            tree, there = Tree(points), unpack(own["v"], wide)
            ids = own["ids"].to_pylist()
            first = np.array([i[0] for i in ids], np.int64)
            for i, (at, score) in enumerate(_search(tree, there, first, x, p, (x * x).sum(1) + top, bound, keep, chi, slack)):
                out.append((score.tolist(), [ids[j] for j in at.tolist()], max(float(bound[i]), float(score[keep - 1]) if len(score) == keep else -math.inf)))
        scores, found, bounds = zip(*out) if out else ((), (), ())
        keys = [ask[c].combine_chunks() for c in ("v", "q", "cell", "part")]
        lists = [pa.array(scores, pa.list_(pa.float64())), pa.array(found, pa.list_(pa.list_(pa.int64()))), pa.array(bounds, pa.float64())]
        return pa.table([*keys, *lists], names=["v", "q", "cell", "part", "scores", "found", "bound"])

    def solved(asks: DataFrame) -> DataFrame:
        """Each query (v, q, cell, part, bound) searched in its part; queries of a part in groups of bounded size."""
        asks = materialise(asks, "kd-asks")
        count = {r["cell"]: r["n"] for r in asks.groupBy("cell", "part").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("n")).collect()}
        if not count:
            return spark.createDataFrame([], result)
        n_groups = F.coalesce(by_cell({c: math.ceil(v / group) for c, v in count.items()}), F.lit(0))
        dealt = asks.withColumn("grp", F.pmod(F.xxhash64("v", F.lit(1)), n_groups).cast("int"))
        sent = data.withColumn("grp", F.explode(F.when(n_groups > 0, F.sequence(F.lit(0), n_groups - 1)))).select("v", "ids", "p", "cell", "part", "grp")
        by = ["cell", "part", "grp"]
        return dealt.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(lambda a, b: solve(a, b), result)

    def onward(batches):
        """The other cells that a query has to go to."""
        import pyarrow as pa

        for b in batches:
            x, p, bound = unpack(b.column(0), wide), unpack(b.column(1), dims), np.asarray(b.column(4))
            far = chi * np.maximum(0.0, (x * x).sum(1) + top - 2 * bound) + slack
            visit = [np.array(known, np.int32)[row].tolist() for row in boxes(p) <= far[:, None]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(visit, pa.list_(pa.int32()))], names=[*b.schema.names, "visit"])

    result = "v binary, q binary, cell int, part int, scores array<double>, found array<array<bigint>>, bound double"
    asks = materialise(flat.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "kd-queries")
    near = materialise(solved(asks.select("v").distinct().mapInArrow(homes, "v binary, q binary, cell int, bound double").withColumn("part", part_of)), "kd-home")
    more = near.select("v", "q", F.col("cell").alias("home"), F.col("part").alias("home_part"), "bound").mapInArrow(onward, "v binary, q binary, home int, home_part int, bound double, visit array<int>")
    more = more.withColumn("cell", F.explode("visit")).withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    rest = solved(more.where("cell <> home or part <> home_part").select("v", "q", "cell", "part", "bound"))
    found = near.select("v", "scores", "found").unionByName(rest.select("v", "scores", "found"))
    found = found.select("v", F.explode(F.arrays_zip("scores", "found")).alias("x")).select("v", F.col("x.scores").alias("score"), F.explode("x.found").alias("vec_id"))
    order = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")
    top_ids = found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= keep).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("i", "vec_id", "score"))).alias("top"))
    own = asks.join(top_ids, "v").select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)).alias("i", "x"))
    return own.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

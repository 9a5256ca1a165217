"""Text weights, co-occurrence, rules, clusters, trees and lines."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}_]{2,})"


#: Characters of the texts of a part, about, which is a task; and as many parts' terms as a task adds up.
PART_CHARS, TERM_PARTS = 1 << 22, 8


def _labels(spark, n: int) -> list[int]:
    """n numbers that repartition(n, ...) by them puts into a partition each; any others would be right too, but less even."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")
    return [r["least"] for r in spark.range(32 * n, numPartitions=1).groupBy(at).agg(F.min("id").alias("least")).orderBy("at").collect()]


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """doc, term, weight: raw counts, smooth idf ln((1+n)/(1+df))+1, unit length per document.

    Texts are dealt into parts of bounded size by document. What a part has to know of other parts is asked for and told once a
    term, so neither the counts nor the weights of all documents are ever shuffled.
    """
    whole = docs.select(F.col(id_col).alias("doc"), F.lower(text_col).alias("text"))
    told = whole.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    labels = _labels(docs.sparkSession, max(1, math.ceil((told["chars"] or 0) / part_chars)))
    tasks, part = len(labels), F.array(*map(F.lit, labels))[F.pmod(F.xxhash64("doc"), F.lit(len(labels))).cast("int")].cast("int")
    terms = lambda d: d.select("part", "doc", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), 1)).alias("term"))
    whole = whole.withColumn("part", part)
    # documents of a part by term; a term's parts are one group, at most a row for each of them
    held = terms(whole.repartition(tasks, "part")).groupBy("part", "doc", "term").agg(F.lit(1).alias("one")).groupBy("part", "term").agg(F.count("*").alias("here"))
    df = held.repartition(math.ceil(tasks / TERM_PARTS), "term").withColumn("df", F.sum("here").over(Window.partitionBy("term"))).where(F.col("df") > F.col("here"))
    # texts and what was told go to their part together; a term that isn't told of has no other documents
    none = lambda kind: F.lit(None).cast(kind)
    both = whole.select("part", "doc", "text", none("string").alias("term"), none("bigint").alias("df"))
    both = both.unionByName(df.select("part", none(dict(whole.dtypes)["doc"]).alias("doc"), none("string").alias("text"), "term", "df"))
    both = both.repartition(tasks, "part")
    found = F.when(F.col("df").isNull(), F.regexp_extract_all("text", F.lit(TOKEN), 1)).otherwise(F.array("term"))
    counted = both.select("part", "doc", "df", F.explode(found).alias("term")).groupBy("part", "doc", "term", "df").agg(F.count("*").alias("tf"))
    by_term = Window.partitionBy("part", "term")
    known = counted.withColumns({"all": F.coalesce(F.max("df").over(by_term), F.count("*").over(by_term))}).where("df is null")
    w = known.select("part", "doc", "term", (F.col("tf") * (F.log((1.0 + F.lit(told["n"])) / (1.0 + F.col("all"))) + 1.0)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("part", "doc")))
    return w.select("doc", "term", (F.col("w") / norm).alias("weight"))


#: Items of a block; the pairs of two blocks of a group are a task's work at most.
PAIR_BLOCK = 1024
#: Rows and pairs that a task gets, about, however long the table is, and the slices of groups that it holds: several, so that tasks come out even.
PAIR_ROWS, PAIRS, SLICES = 1 << 18, 1 << 20, 16


def _dealt(rows: DataFrame, item: str, together: list[str], counted: str, block: int):
    """Distinct rows with the slice of each group, the number of tasks for them, and that of groups without a null.

    Spark sizes tasks by the bytes they read, which pairs and their counts outgrow many times, so the tasks are counted here.
    """
    names = [item, *dict.fromkeys([*together, counted])]
    own, m = rows.select(*names), F.col("_m")
    whole = F.count_if(reduce(and_, (F.col(c).isNotNull() for c in together)))
    told = own.groupBy(*together).agg(F.count("*").alias("_m")).agg(F.sum(m).alias("rows"), F.sum(F.when(m <= block, m * (m - 1) / 2)).alias("pairs"), whole.alias("groups")).first()
    tasks = max(1, math.ceil((told["rows"] or 0) / PAIR_ROWS), math.ceil((told["pairs"] or 0) / PAIRS))
    own = own.repartition(tasks, *names).distinct().withColumn("_slice", F.pmod(F.xxhash64(*together), F.lit(SLICES * tasks)).cast("int"))
    return own, tasks, told["groups"]


def _pairs(own: DataFrame, tasks: int, item: str, together: list[str], counted: str, least: int, block: int) -> DataFrame:
    by = ["_slice", *together]
    own = own.where(reduce(and_, (F.col(c).isNotNull() for c in (item, *together)))).repartition(tasks, "_slice")
    own = own.withColumn("_blocks", F.ceil(F.count("*").over(Window.partitionBy(*by)) / block).cast("int"))
    extra = [] if counted in together else [counted]
    kept = [*by, "_p", "_q"]
    # a group of one block is an array, made where its rows are; only the blocks of larger ones are dealt out
    member = F.struct(F.col(item).alias("i"), *(F.col(c).alias("c") for c in extra))
    small = own.where("_blocks = 1").groupBy(*by).agg(F.array_sort(F.collect_list(member)).alias("_all"))
    small = small.select(*by, "_all", F.posexplode("_all").alias("_at", "_p")).where(F.col("_at") + 1 < F.size("_all"))
    small = small.withColumn("_q", F.explode(F.slice("_all", F.col("_at") + 2, F.size("_all")))).where(F.col("_p.i") != F.col("_q.i")).select(*kept)
    own = own.where("_blocks > 1").withColumn("_own", F.pmod(F.xxhash64(F.col(item)), F.col("_blocks")).cast("int")).select(*by, "_blocks", "_own", member.alias("_p"))
    left = own.withColumns({"_i": F.col("_own"), "_j": F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1))})
    right = own.withColumns({"_i": F.explode(F.sequence(F.lit(0), F.col("_own"))), "_j": F.col("_own")}).select(*by, F.col("_p").alias("_q"), "_i", "_j")
    large = left.join(right, [*by, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("_p.i") < F.col("_q.i"))).where(F.col("_p.i") != F.col("_q.i"))
    first, last = (F.when(F.col("_p.i") < F.col("_q.i"), F.col(x)).otherwise(F.col(y)) for x, y in (("_p", "_q"), ("_q", "_p")))
    small, large = (d.withColumns({"a": F.col("_p.i"), "b": F.col("_q.i")}) for d in (small, large.select(*by, first.alias("_p"), last.alias("_q"))))
    if [counted] == together:
        # a group that is counted itself has each of its pairs once; a slice counts its pairs where they are made, so the pairs of many groups are few rows
        told = [d.groupBy("_slice", "a", "b").agg(F.count("*").alias("n")).select("a", "b", "n") for d in (small, large)]
        found = told[0].unionByName(told[1]).repartition(tasks, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    else:
        found = small.unionByName(large).groupBy("a", "b").agg(F.count_distinct(F.col("_p.c") if extra else F.col(counted)).alias("n"))
    return found.where(F.col("n") >= least)


def copairs(rows: DataFrame, item: str, together: list[str], counted: str, least: int = 2, block: int = PAIR_BLOCK) -> DataFrame:
    """Pairs of items that share a group, with the distinct values of ``counted`` over their groups; at least so many.

    A group's items are dealt into blocks by hash, and each pair of blocks, a triangle of them, is a join key of its own, so
    a large group is many tasks; a group that fits one block is one key.
    """
    own, tasks, _ = _dealt(rows, item, together, counted, block)
    return _pairs(own, tasks, item, together, counted, least, block)


def pair_rules(baskets: DataFrame, basket: str, item: str, least: int = 2) -> DataFrame:
    """a, b, n, support, confidence of a -> b for pairs in at least so many baskets."""
    own, tasks, total = _dealt(baskets, item, [basket], basket, PAIR_BLOCK)
    single = own.groupBy(F.col(item).alias("a")).agg(F.count(basket).alias("na"))
    both = _pairs(own, tasks, item, [basket], basket, least, PAIR_BLOCK)
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.join(single, "a").select("a", "b", "n", (F.col("n") / F.lit(total)).alias("support"), (F.col("n") / F.col("na")).alias("confidence"))


def rule_of(baskets: DataFrame, items: str, left: list, right: list) -> DataFrame:
    """Support and confidence of one rule over baskets given as arrays."""
    has = lambda xs: F.size(F.array_except(F.array(*map(F.lit, xs)), F.col(items))) == 0
    both, ante = F.count_if(has([*left, *right])), F.count_if(has(left))
    return baskets.agg((both / F.count("*")).alias("support"), (both / ante).alias("confidence"))


def line_fit(rows: DataFrame, y: str, x: str) -> DataFrame:
    return rows.agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


#: Distinct vectors that k-means starts are made on, starts, and most passes over all rows.
KMEANS_SAMPLE, KMEANS_STARTS, KMEANS_ROUNDS = 4096, 16, 100


def _starts(x, weight, k: int, starts: int, seed: int, rounds: int = 50):
    """Centres of each start: drawn by distance from those before, then refined on the sample."""
    import numpy as np

    gap = lambda c: ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    out = []
    for s in range(starts):
        rng = np.random.default_rng([seed, s])
        c = x[[rng.choice(len(x), p=weight / weight.sum())]]
        while len(c) < k and (far := gap(c).min(1) * weight).sum() > 0:
            c = np.vstack([c, x[rng.choice(len(x), p=far / far.sum())]])
        for _ in range(rounds):
            near = gap(c).argmin(1)
            moved = np.array([np.average(x[near == i], axis=0, weights=weight[near == i]) if (near == i).any() else c[i] for i in range(len(c))])
            if np.allclose(moved, c, rtol=0, atol=1e-12):
                break
            c = moved
        out.append((float((gap(c).min(1) * weight).sum()), s, c))
    return [c for _, _, c in sorted(out, key=lambda o: o[:2])]


def kmeans_centres(points: DataFrame, column: str, k: int, seed: int = 42, starts: int = KMEANS_STARTS, sample: int = KMEANS_SAMPLE, rounds: int = KMEANS_ROUNDS) -> list[list[float]]:
    """At most k centres of an array column, least cost of several starts, in lexicographic order.

    The sample is chosen by a hash of the vectors and weighed by their copies, so it depends neither on partitions nor on the order
    of rows; the best three starts are then compared over all rows, in one job, and the best goes on, a job a pass.
    """
    import numpy as np

    x = F.col(column)
    rows = points.where(x.isNotNull()).select(x.alias("x"))
    n = rows.count()
    if not n:
        return []
    place = F.xxhash64("x", F.lit(seed))
    chosen = rows.where(F.pmod(place, F.lit(max(1, n // sample))) == 0)
    # where few distinct vectors stand in many copies, the hash may choose none of them
    some = (rows if chosen.isEmpty() else chosen).groupBy("x").agg(F.count("*").alias("w")).orderBy(place, "x").limit(sample).collect()
    best = _starts(np.array([r["x"] for r in some]), np.array([r["w"] for r in some], float), k, starts, seed)[:3]
    told = _lloyd(rows, best)
    first = int(np.argmin([cost for cost, _ in told]))
    centres, (cost, moved) = best[first], told[first]
    for _ in range(rounds):
        less, further = _lloyd(rows, [moved])[0]
        if less >= cost - 1e-7 * cost:
            break
        centres, cost, moved = moved, less, further
    return sorted(np.round(centres, 12).tolist())


def _gaps(x, centres):
    """Squared distances of an array column to each centre."""
    square = lambda a, b: (a - b) * (a - b)
    return F.array(*(F.aggregate(F.zip_with(x, F.array(*map(F.lit, c)), square), F.lit(0.0), lambda a, v: a + v) for c in centres))


def _nearest(gaps):
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def _lloyd(rows: DataFrame, sets) -> list:
    """(cost, moved centres) of each set of centres, in one pass: distances in Arrow batches, a row for each set, cluster and batch, summed by Spark."""
    import numpy as np

    dims = len(sets[0][0])
    centres = [np.asarray(c, float) for c in sets]

    def summed(batches):
        import pyarrow as pa

        for b in batches:
            x = np.asarray(b.column(0).flatten(), float).reshape(-1, dims)
            for i, c in enumerate(centres):
                gap = np.stack([((x - m) ** 2).sum(1) for m in c], 1)
                near, least = gap.argmin(1), gap.min(1)
                for k in np.unique(near):
                    own = near == k
                    row = {"s": [i], "c": [int(k)], "m": [int(own.sum())], "cost": [float(least[own].sum())]} | {f"x{j}": [float(v)] for j, v in enumerate(x[own].sum(0))}
                    yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("s", pa.int32()), ("c", pa.int32()), ("m", pa.int64()), *((n, pa.float64()) for n in ["cost", *(f"x{j}" for j in range(dims))])]))

    kinds = ", ".join(["s int", "c int", "m bigint", "cost double", *(f"x{j} double" for j in range(dims))])
    found = rows.select("x").mapInArrow(summed, kinds).groupBy("s", "c").agg(F.sum("cost").alias("cost"), *((F.sum(f"x{j}") / F.sum("m")).alias(f"x{j}") for j in range(dims))).collect()
    out = []
    for i, c in enumerate(centres):
        own, moved = [r for r in found if r["s"] == i], np.array(c)
        for r in own:
            moved[r["c"]] = [r[f"x{j}"] for j in range(dims)]
        out.append((sum(r["cost"] for r in own), moved))
    return out


def kmeans(rows: DataFrame, features: list[str], k: int, scaled: bool = True, seed: int = 42) -> DataFrame:
    """rows with the cluster of each; null where a feature is. Scaled features have mean 0 and standard deviation 1; constant ones count nothing then."""
    numbers = [F.col(c).cast("double") for c in features]
    if scaled:
        told = rows.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(numbers) for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
        numbers = [(c - F.lit(told[f"m{i}"])) / F.lit(told[f"s{i}"]) if told[f"s{i}"] else F.when(c.isNotNull(), 0.0) for i, c in enumerate(numbers)]
    whole = F.array(*numbers)
    points = rows.withColumn("_x", F.when(~F.exists(whole, lambda v: v.isNull() | F.isnan(v)), whole))
    centres = kmeans_centres(points, "_x", k, seed)
    cluster = _nearest(_gaps(F.col("_x"), centres)) if centres else F.lit(None).cast("int")
    return points.withColumn("cluster", F.when(F.col("_x").isNotNull(), cluster)).drop("_x")


def decision_tree(rows: DataFrame, features: list[str], label: str, id_col: str, depth: int = 3, seed: int = 42, held: int = 4) -> DataFrame:
    """The rows of one part in ``held`` (by a hash of the id) with the prediction of a tree grown on the others."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    steps = [VectorAssembler(inputCols=features, outputCol="_x"), DecisionTreeClassifier(maxDepth=depth, seed=seed, featuresCol="_x", labelCol=label, rawPredictionCol="_r", probabilityCol="_p", predictionCol="predicted")]
    out = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(held)) == 0
    return Pipeline(stages=steps).fit(rows.where(~out)).transform(rows.where(out)).drop("_x", "_r", "_p")

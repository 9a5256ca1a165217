"""Quality rules with a robust multivariate outlier test.

Base rules reject short or self-repeating documents. Of the rest, each (language, source) group gets a minimum
covariance determinant estimate of its transformed statistic vectors, and a document is rejected when its squared
Mahalanobis distance from its group's estimate is above a chi-square cut-off.

The estimate runs over all rows, not a sample. Three starts (coordinate-wise median and scaled median absolute deviation;
mean and covariance of the rows near the median in every coordinate; of all rows) take SCREEN concentration steps each:
the h nearest rows give the next mean and covariance. The start with the smallest determinant goes on until the
determinant shrinks no more. A step is two passes of mergeable aggregates, a counted histogram of distances (its buckets
are fixed, so the h nearest are the rows up to the bucket that holds the h-th: the same however rows are dealt out) and
sums (repeatable up to the rounding of doubles), so a group holding a third of all rows is summed by all tasks. The covariance is regularised by fixed floors, since
most documents have no symbols or repeats at all and the plain determinant would be 0; the determinants compared are of
the regularised ones. Groups under ``min_group`` rows are pooled by language, then with all others.

Defined results: null text counts as empty (0 words, base_failed); null lang or source are groups of their own;
repeated rows count as often as they stand there; an empty table gives an empty table; extra columns pass through
keep() untouched and are ignored by verdicts().
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm.common import BROADCAST_BYTES, WORD_PY, materialise, own_names, tables

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Standard deviations that a dimension has at least: log words, log word length, log symbols per 100 characters, log duplicate lines, log repeated words per 100 words.
FLOORS = (0.35, 0.04, 0.25, 0.6, 0.8)
DIMS = len(FLOORS)
#: Share of a group that the estimate is made of: half, so that outliers up to just under half of a group stay out of it.
#: The usual DIMS + 1 rows more keep a plain covariance invertible; here the floors do.
H_SHARE = 0.5
MIN_GROUP = 50
#: Concentration steps of each start before the best goes on; a determinant must shrink by this share to count as smaller.
SCREEN, SHRINK = 2, 1e-9
#: Buckets a floor of a coordinate's histogram and an octave of a distance's.
PER_FLOOR, PER_OCTAVE = 32, 32
STARTS = 3
#: Bytes that a group's name and radius take in a broadcast, about.
GROUP_BYTES = 400
#: Chance that a document of a normal group lies beyond the cut-off.
ALPHA = 1e-9


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution for odd or even k, by the recurrence over k."""
    if x <= 0:
        return 1.0
    q, i = (math.erfc(math.sqrt(x / 2)), 1) if k % 2 else (math.exp(-x / 2), 2)
    while i < k:
        q += math.exp((i / 2) * math.log(x / 2) - x / 2 - math.lgamma(i / 2 + 1))
        i += 2
    return q


def chi2_quantile(upper: float, k: int) -> float:
    lo, hi = 0.0, 2000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_sf(mid, k) > upper else (lo, mid)
    return lo


CUT = chi2_quantile(ALPHA, DIMS)
#: What makes the covariance of the nearest H_SHARE of a normal sample that of the whole.
CONSISTENCY = H_SHARE / (1 - chi2_sf(chi2_quantile(1 - H_SHARE, DIMS), DIMS + 2))


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    import numpy as np

    if not text:
        return 0, 0, 0, 0, 0
    words = _words(text)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(SPACES):
                seen.add(line)
    n, repeat = len(words), 0
    if n > WINDOW and len(set(words)) <= n - WINDOW:  # a repeated window repeats each of its words' places
        ids: dict[str, int] = {}
        x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
        x = _mixed(x)
        h = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + len(h)]
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if same.any():
            hit = np.zeros(len(h), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, dup, repeat


_words = re.compile(WORD_PY).findall


def _mixed(x):
    """64-bit finaliser over an unsigned array."""
    import numpy as np

    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def with_stats(docs: DataFrame, text_col: str, names: list[str], keep: list[str]) -> DataFrame:
    """The kept columns of docs and the five statistics under the given names; one pass over the whole texts."""
    columns = [F.col(f"`{c}`") for c in keep]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = list(zip(*(text_stats(t.as_py()) for t in b.column(len(keep))))) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(c, pa.int64()) for c in cols)], names=[*keep, *names])

    src = docs.select(*columns, F.col(f"`{text_col}`").alias(own_names(keep, "text_in")[0]))
    schema = src.select(*columns).schema
    for n in names:
        schema = schema.add(n, "long")
    return src.mapInArrow(run, schema)


def _vector(names: list[str]) -> list:
    words, chars, symbols, dup, repeat = (F.col(n).cast("double") for n in names)
    some = F.greatest(words, F.lit(1.0))
    return [
        F.log(some),
        F.log(F.greatest(chars, F.lit(1.0)) / some),
        F.log1p(100.0 * symbols / F.greatest(chars, F.lit(1.0))),
        F.log1p(dup),
        F.log1p(100.0 * repeat / some),
    ]


def base_failed(names) -> F.Column:
    return (F.col(names[0]) < MIN_WORDS) | (100 * F.col(names[4]) > REPEAT_PERCENT * F.col(names[0]))


PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
Z = [f"z{i}" for i in range(DIMS)]


def _middle(values: DataFrame, share: float) -> DataFrame:
    """For each g, k of values (g, k, bucket): the least bucket up to which that share of its rows lie. Counted, so the histogram and not the rows are sorted."""
    counts = values.groupBy("g", "k", "bucket").agg(F.count("*").alias("c"))
    by = Window.partitionBy("g", "k")
    upto = counts.withColumns({"upto": F.sum("c").over(by.orderBy("bucket")), "all": F.sum("c").over(by)})
    return upto.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy("g", "k").agg(F.min("bucket").alias("bucket"))


def _sums() -> list:
    """Aggregates that give the mean and covariance of rows z0.. and their number."""
    return [F.count("*").alias("n"), F.array(*(F.sum(c) for c in Z)).alias("s"), F.array(*(F.sum(F.col(Z[i]) * F.col(Z[j])) for i, j in PAIRS)).alias("ss")]


def _fitted(moments: DataFrame, scales: dict) -> DataFrame:
    """g, k, mu, inv, det from moments (g, k, n, s, ss); scales: what the covariance of each k is multiplied by."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            mus, invs, dets = [], [], []
            for r in pdf.itertuples(index=False):
                mu = np.array(r.s, float) / r.n
                cov = np.zeros((DIMS, DIMS))
                for (i, j), v in zip(PAIRS, r.ss):
                    cov[i, j] = cov[j, i] = v / r.n - mu[i] * mu[j]
                cov = cov * scales.get(r.k, 1.0) + np.diag(np.square(FLOORS))
                mus.append(mu.tolist())
                invs.append(np.linalg.inv(cov).ravel().tolist())
                dets.append(float(np.linalg.det(cov)))
            yield pd.DataFrame({"g": pdf["g"], "k": pdf["k"], "mu": mus, "inv": invs, "det": dets})

    return moments.select("g", "k", "n", "s", "ss").mapInPandas(run, "g string, k int, mu array<double>, inv array<double>, det double")


def _starts(rows: DataFrame) -> DataFrame:
    """g, k, mu, inv, det of the STARTS first estimates of each group."""
    step = [f / PER_FLOOR for f in FLOORS]
    cells = lambda x: F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.floor(x(i) / step[i]).alias("bucket")) for i in range(DIMS))))
    each = lambda m: F.array(*(F.max(F.when(F.col("k") == i, (F.col("bucket") + 0.5) * step[i])) for i in range(DIMS))).alias(m)
    med = _middle(rows.select("g", cells(lambda i: F.col(Z[i])).alias("x")).select("g", "x.*"), 0.5)
    med = materialise(med.groupBy("g").agg(each("med")), "mcd-median")
    off = rows.join(med, "g").select("g", cells(lambda i: F.abs(F.col(Z[i]) - F.col("med")[i])).alias("x")).select("g", "x.*")
    mad = materialise(_middle(off, 0.5).groupBy("g").agg(each("mad")).join(med, "g"), "mcd-mad")
    # the median and deviation as moments of one row, so that all starts are fitted alike
    square = lambda i, j: F.col("med")[i] * F.col("med")[j] + (F.pow(1.4826 * F.col("mad")[i], 2) if i == j else F.lit(0.0))
    first = mad.select("g", F.lit(0).alias("k"), F.lit(1).cast("bigint").alias("n"), F.col("med").alias("s"), F.array(*(square(i, j) for i, j in PAIRS)).alias("ss"))
    near = F.greatest(*(F.abs(F.col(Z[i]) - F.col("med")[i]) / (2 * 1.4826 * F.col("mad")[i] + FLOORS[i]) for i in range(DIMS))) <= 1
    which = F.explode(F.when(near, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))).alias("k")
    others = rows.join(mad, "g").select("g", *Z, which).groupBy("g", "k").agg(*_sums())
    return materialise(_fitted(first.unionByName(others.select(*first.columns)), {}), "mcd")


def _bucket(d2):
    """The place of a squared distance on a scale of PER_OCTAVE buckets an octave."""
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-12))) * PER_OCTAVE)


def _concentrated(rows: DataFrame, now: DataFrame, few: bool = False) -> DataFrame:
    """The next estimates: of the H_SHARE of each group's rows that are nearest by now (g, k, mu, inv, det). few: the groups are few enough to broadcast a row of each, so that no row of a group is shuffled."""
    placed = rows.join(now.select("g", "k", "mu", "inv"), "g").withColumn("bucket", _bucket(distance2([F.col(c) for c in Z])))
    radius = _middle(placed.select("g", "k", "bucket"), H_SHARE).withColumnRenamed("bucket", "radius")
    inside = placed.join(F.broadcast(radius) if few else radius, ["g", "k"]).where("bucket <= radius")
    return _fitted(inside.groupBy("g", "k").agg(*_sums()), {k: CONSISTENCY for k in range(STARTS)})


def _estimates(rows: DataFrame) -> DataFrame:
    """g, mu array, inv array (row-major inverse of the scatter), det: the estimate of every group. rows: a table of g, z0.. of the rows that take part."""
    now = _starts(rows)
    few = now.count() * GROUP_BYTES <= BROADCAST_BYTES
    for _ in range(SCREEN):
        now = materialise(_concentrated(rows, now, few), "mcd")
    best = now.groupBy("g").agg(F.min(F.struct("det", "k", "mu", "inv")).alias("b")).select("g", "b.*", F.lit(True).alias("moved"))
    best = materialise(best, "mcd-best")
    while not best.where("moved").isEmpty():  # determinants only shrink, so this ends; groups that have ended take no part
        going = best.where("moved")
        then = _concentrated(rows.join(going.select("g"), "g", "left_semi"), going, few).select("g", F.struct("det", "k", "mu", "inv").alias("then"))
        smaller = F.coalesce(F.col("then.det") < F.col("det") * (1 - SHRINK), F.lit(False))
        best = best.join(then, "g", "left").select("g", *(F.when(smaller, F.col(f"then.{c}")).otherwise(F.col(c)).alias(c) for c in ("det", "k", "mu", "inv")), smaller.alias("moved"))
        best = materialise(best, "mcd-best")
    return best.drop("moved")


def distance2(z: list) -> F.Column:
    """Squared Mahalanobis distance of the columns z from mu under inv."""
    d = [z[i] - F.col("mu")[i] for i in range(DIMS)]
    return sum((d[i] * F.col("inv")[DIMS * i + j] * d[j] * (1.0 if i == j else 2.0) for i in range(DIMS) for j in range(i, DIMS)), F.lit(0.0))


def judged(stats: DataFrame, lang: str, source: str, names: list[str], out: tuple[str, str, str], min_group: int = MIN_GROUP, cut: float = CUT) -> DataFrame:
    """stats and the columns base_failed, kept and squared distance under the names in out. stats should be a written table; it is read several times."""
    sep = "\x1f"
    nul = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    own, by_lang = F.concat_ws(sep, F.lit("own"), nul(lang), nul(source)), F.concat_ws(sep, F.lit("lang"), nul(lang))
    passed = stats.where(~base_failed(names)).select(nul(lang).alias("l"), own.alias("o"), by_lang.alias("b"), *(e.alias(f"z{i}") for i, e in enumerate(_vector(names))))
    sizes = passed.groupBy("o").agg(F.count("*").alias("n"), F.first("b").alias("b"))
    pooled = sizes.where(F.col("n") < min_group).groupBy("b").agg(F.sum("n").alias("m"))
    to = sizes.join(pooled, "b", "left").select("o", F.when(F.col("n") >= min_group, F.col("o")).when(F.col("m") >= min_group, F.col("b")).otherwise(F.lit("all")).alias("g"))
    to = materialise(to, "mcd-groups")
    with tables(stats.sparkSession) as drop:
        fit = _estimates(materialise(passed.join(to, "o").select("g", *Z), "mcd-rows"))
        drop(fit)
    o, g, mu, inv, d2 = own_names(stats.columns, "o", "g", "mu", "inv", "d2")
    params = to.join(fit, "g").select(F.col("o").alias(o), F.col("g").alias(g), F.col("mu").alias(mu), F.col("inv").alias(inv))
    params = materialise(params, "mcd-params")
    z = _vector(names)
    d = [z[i] - F.col(mu)[i] for i in range(DIMS)]
    dist = sum((d[i] * F.col(inv)[DIMS * i + j] * d[j] * (1.0 if i == j else 2.0) for i in range(DIMS) for j in range(i, DIMS)), F.lit(0.0))
    failed = base_failed(names)
    rows = stats.withColumn(o, own).join(params, o, "left").withColumn(d2, F.when(~failed, dist))
    return rows.select(*(F.col(f"`{c}`") for c in stats.columns), failed.alias(out[0]), (~failed & (F.coalesce(F.col(d2), F.lit(0.0)) <= cut)).alias(out[1]), F.col(d2).alias(out[2]))


def verdicts(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the five statistics, base_failed, kept, distance2 of every row of docs (doc_id, text, lang, source)."""
    slim = docs.select("doc_id", "lang", "source", "text")
    stats = materialise(with_stats(slim, "text", list(STATS), ["doc_id", "lang", "source"]), "quality-stats")
    return judged(stats, "lang", "source", list(STATS), ("base_failed", "kept", "distance2"), **limits).select("doc_id", *STATS, "base_failed", "kept", "distance2")


def keep(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that are kept, with all their columns and no others. The statistics are written beside the rows once, so texts are read once and never shuffled."""
    names = own_names(docs.columns, *STATS)
    out = tuple(own_names([*docs.columns, *names], "base_failed", "kept", "distance2"))
    stats = materialise(with_stats(docs, "text", names, docs.columns), "quality-docs")
    return judged(stats, "lang", "source", names, out, **limits).where(F.col(out[1])).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Packing by optimal length buckets.

Documents are cut into pieces of at most ``max_tokens`` words. The global histogram of piece lengths (at most
``max_tokens`` + 1 rows, whatever the input) goes to the driver, where dynamic programming chooses the bucket
boundaries that make the total padding smallest. Inside a bucket, batches of token_budget // boundary pieces form.
A piece's place in its bucket is its shard's offset plus its number in the shard; shards are hashes of bounded size, so a
bucket that holds a third of all pieces is numbered by many tasks.

Defined results: null or empty text, or one without words, is one piece of 0 tokens in the smallest bucket; repeated
rows are pieces of their own; an empty table gives an empty table; extra columns are ignored. Which batch a piece falls
in depends on ids and lengths only, not on partitioning; pieces that are equal in both are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm.common import WORD_JAVA, materialise

MAX_TOKENS, BUCKETS, TOKEN_BUDGET = 2048, 16, 65_536
#: Pieces numbered by one task, on average at most.
SHARD = 50_000


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Ascending upper bounds of at most so many buckets that make sum(count * (bound - length)) smallest; every bound is a length that occurs."""
    import numpy as np

    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m = len(x)
    if m == 0:
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    # cost[j]: least padding of the first j lengths so far; the last bucket holds lengths i..j-1
    ends = np.arange(1, m + 1)
    cost = np.concatenate([[0], x * rows[ends] - tokens[ends]])
    cut = [np.zeros(m + 1, np.int64)]
    for k in range(1, min(buckets, m)):
        now, at = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            c = cost[:j] + x[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            at[j] = int(c.argmin())
            now[j] = c[at[j]]
        cost = now
        cut.append(at)
    out, j = [], m
    for at in reversed(cut):
        if j == 0:
            break
        out.append(int(x[j - 1]))
        j = int(at[j])
    return sorted(set(out))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start_token, n_tokens: each document cut into runs of at most max_tokens words."""
    n = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD_JAVA)), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), n.cast("bigint").alias("all_tokens"))
    last = F.greatest(F.lit(0), F.ceil(F.col("all_tokens") / max_tokens).cast("int") - 1)
    cut = rows.select("doc_id", "all_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * max_tokens
    return cut.select("doc_id", "piece", start.alias("start_token"), F.least(F.lit(max_tokens), F.col("all_tokens") - start).cast("int").alias("n_tokens"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, piece, start_token, n_tokens, bucket_tokens (what it is padded to), batch_id (bucket_tokens and number), slot (place in the batch)."""
    cut = materialise(pieces(docs, id_col, text_col, max_tokens), "packing")
    hist = cut.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()  # max_tokens + 1 rows at most
    lengths, counts = [r["n_tokens"] for r in hist], [r["c"] for r in hist]
    bounds = boundaries(lengths, counts, buckets)
    if not bounds:
        bounds = [max_tokens]
    padded, b = [], 0
    for n in range(max_tokens + 1):
        while b < len(bounds) - 1 and bounds[b] < n:
            b += 1
        padded.append(bounds[b])
    size = F.element_at(F.array(*(F.lit(p) for p in padded)), F.col("n_tokens") + 1)
    shards = max(1, -(-sum(counts) // SHARD))
    rows = cut.withColumn("bucket_tokens", size).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    per = rows.groupBy("bucket_tokens", "shard").agg(F.count("*").alias("c"))  # buckets times shards rows
    before = per.withColumn("offset", F.sum("c").over(Window.partitionBy("bucket_tokens").orderBy("shard")) - F.col("c")).drop("c")
    before = materialise(before, "packing-offsets")
    number = F.row_number().over(Window.partitionBy("bucket_tokens", "shard").orderBy("doc_id", "piece", "n_tokens")) - 1
    rows = rows.withColumn("number", number).join(before, ["bucket_tokens", "shard"])
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("bigint")
    at = F.col("offset") + F.col("number")
    batch = F.concat_ws("-", F.col("bucket_tokens").cast("string"), F.floor(at / room).cast("string"))
    return rows.select("doc_id", "piece", "start_token", "n_tokens", "bucket_tokens", batch.alias("batch_id"), F.pmod(at, room).cast("int").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Ranked lexical search over document shards of CSR postings with precomputed integer impacts.

The index is a table of shards, each of at most SHARD_BYTES of text (a longer document is a shard of its own). A shard
holds its documents' ids, its distinct terms, and in CSR form the documents and impacts of each term; an impact is the
integer (1000000000 tf) div (1000 tf + 8 m), which needs two numbers of the whole corpus only: its documents N and its terms
L. A term's weight depends on how many documents hold it; that is summed from the shards' dictionaries for the terms
asked for. Items are dealt into blocks of bounded size, each (shard, block) pair is scored term at a time into a
dense accumulator, the best k of a shard are taken with argpartition, every tie at the edge included, and the shards' best
are merged by a window that Spark limits before its shuffle.

Defined results: a null or empty text has no terms, and counts neither as a document nor matches; rows with a null id take
no part; repeated rows of documents are documents of their own, so an id can come more than once; rows of one item id are one
item with the terms of all; an item without terms, or whose terms no document holds, returns nothing; equal scores go to
the smaller doc_id; empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm.common import BROADCAST_BYTES, LARGE_ROWS, materialise

#: What separates terms: all ASCII characters but letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
#: Bytes of text of a shard, and (item, term) entries of a block of items, an item's own terms always staying together.
SHARD_BYTES, BLOCK_ENTRIES = 4 << 20, 20_000
#: Bytes of text in which terms are counted at once.
COUNTED_BYTES = 1 << 20
#: Fixed values of the score: its scale, how fast repeats saturate, and how much length counts.
ONE, SATURATION, LENGTH = 1_000_000_000, 8, 75

_KEPT = frozenset(string.ascii_letters + string.digits)
#: Bytes of a term as they are, A to Z lower-cased, and everything else a space.
_BYTES = bytes(ord(chr(b).lower()) if chr(b) in _KEPT else b if b > 127 else 32 for b in range(256))
SHARD = "docs binary, terms array<string>, df array<int>, at binary, impacts binary, ids binary"


def terms_of(text: str | Column) -> Column:
    """The terms of a text, in order, with repeats."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(TERM), 0)


def _plain(texts):
    """Offsets of an Arrow array of texts, and their bytes with terms lower-cased and spaces for all else."""
    import numpy as np
    import pyarrow as pa

    raw = texts.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    return offsets - offsets[0], memoryview(data)[offsets[0] : offsets[-1]].tobytes().translate(_BYTES) if data is not None else b""


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms of them; a row of counts for each Arrow batch is summed."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            n_docs = n_terms = 0
            for part in _slices(b, 0, COUNTED_BYTES):
                at, data = _plain(part.column(0))
                held = np.frombuffer(data, np.uint8) != 32
                begins = held.copy()
                begins[1:] &= ~held[:-1]
                # a text's first byte begins a term whatever stands before it
                first = at[:-1][at[:-1] < at[1:]]
                begins[first] = held[first]
                n = np.add.reduceat(begins, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["docs", "terms"])

    got = docs.select("text").mapInArrow(counted, "docs bigint, terms bigint").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "terms"))).first()
    return got["docs"], got["terms"]


def _shard(ids, texts, n_docs: int, n_terms: int):
    """One row of the index: CSR postings of an Arrow array of texts, or None if they hold no term."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    offsets, plain = _plain(texts)
    clean = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(plain)])
    parts = pc.split_pattern(clean, " ")
    length = np.diff(np.asarray(parts.offsets))
    coded = parts.flatten().dictionary_encode()
    words, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), length)
    full = np.asarray(pc.binary_length(words)) > 0
    keep = full[code] if len(code) else np.zeros(0, bool)
    if not keep.any():
        return None
    code, doc = code[keep], doc[keep]
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    key, tf = np.unique(code * len(texts) + doc, return_counts=True)
    code, doc = key // len(texts), key % len(texts)
    m = 100 - LENGTH + (LENGTH * n * n_docs) // n_terms
    impact = (ONE * tf.astype(np.int64)) // (1000 * tf + SATURATION * m[doc])
    held, df = np.unique(code, return_counts=True)
    at = np.concatenate([[0], np.cumsum(df)])
    return {
        "docs": doc.astype("<i4").tobytes(), "terms": pc.take(words, pa.array(held)).cast(pa.string()), "df": pa.array(df.astype(np.int32)),
        "at": at.astype("<i8").tobytes(), "impacts": impact.astype("<i4").tobytes(), "ids": np.asarray(ids, np.int64).astype("<i8").tobytes(),
    }


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The shards of docs (doc_id, text), written to the shared folder, and the number of documents with a term."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    n_docs, n_terms = totals(own)

    def shards(batches):
        import pyarrow as pa

        schema = pa.schema([("docs", pa.binary()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("at", pa.binary()), ("impacts", pa.binary()), ("ids", pa.binary())])

        def made(held):
            row = _shard(pa.concat_arrays([x.column(0) for x in held]), pa.concat_arrays([x.column(1).cast(pa.large_string()) for x in held]), n_docs, n_terms)
            if row:
                lists = {k: pa.ListArray.from_arrays(pa.array([0, len(row[k])], pa.int32()), row[k]) for k in ("terms", "df")}
                yield pa.RecordBatch.from_arrays([lists.get(f.name, None) if f.name in lists else pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        held, size = [], 0
        for b in batches:
            for part in _slices(b, 1, shard_bytes):
                more = part.column(1).nbytes
                if held and size + more > shard_bytes:
                    yield from made(held)
                    held, size = [], 0
                held.append(part)
                size += more
        if held:
            yield from made(held)

    return materialise(own.mapInArrow(shards, SHARD), "lexical-index", LARGE_ROWS), n_docs


def _slices(batch, column: int, most: int):
    """The batch in pieces of at most so many bytes of text each, or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _small(df: DataFrame, size: int) -> DataFrame:
    """df with a broadcast hint if its measured bytes allow it."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def entries(items: DataFrame, shards: DataFrame) -> DataFrame:
    """item_id, term, times, df: each item's terms that a document holds, how often it has them, and in how many documents they are."""
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(terms_of(F.col("text").cast("string"))).alias("term")).where("item_id is not null")
    asked = materialise(asked.groupBy("item_id", "term").agg(F.count("*").alias("times")), "lexical-terms")
    size = asked.agg(F.sum(F.octet_length("term") + 16).alias("n")).first()["n"] or 0
    held = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    held = held.join(_small(asked.select("term").distinct(), size), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    return asked.join(held, "term").select("item_id", "term", "times", "df")


def _best(score, ids, k: int):
    """Positions of the k highest scores above 0, equal scores by id; what ties with the k-th is looked at as a whole."""
    import numpy as np

    hit = np.flatnonzero(score > 0)
    if len(hit) > k:
        got = score[hit]
        edge = got[np.argpartition(got, len(got) - k)[len(got) - k]]
        hit = hit[got >= edge]
    return hit[np.lexsort((ids[hit], -score[hit]))][:k]


def search(items: DataFrame, shards: DataFrame, n_docs: int, k: int = K, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents."""
    own = entries(items, shards)
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("bigint") * F.col("times")
    own = materialise(own.select("item_id", "term", weight.alias("weight")).where("weight > 0"), "lexical-weights")
    told = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("term") + 24).alias("size")).first()
    n_blocks = -(-told["n"] // block_entries)
    if not n_blocks:
        return own.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int")
    blocks = own.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item_id", "term", "weight")).alias("asked"))
    blocks = materialise(blocks.select("block", *(F.col(f"asked.{c}").alias(c) for c in ("item_id", "term", "weight"))), "lexical-blocks")
    pairs = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = pairs.join(_small(blocks, told["size"]), "block").select("ids", "docs", "at", "impacts", "terms", "item_id", "term", "weight")

    def scored(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            for r in range(b.num_rows):
                ids, docs, at, impacts = (np.frombuffer(b.column(i)[r].as_buffer(), kind) for i, kind in enumerate(("<i8", "<i4", "<i8", "<i4")))
                place = np.asarray(pc.fill_null(pc.index_in(b.column(6)[r].values, value_set=b.column(4)[r].values), -1))
                item, weight = np.asarray(b.column(5)[r].values), np.asarray(b.column(7)[r].values)
                order = np.argsort(item, kind="stable")
                order = order[place[order] >= 0]
                out = ([], [], [])
                for run in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else ():
                    total = np.zeros(len(ids), np.int64)
                    for e in run:
                        lo, hi = at[place[e]], at[place[e] + 1]
                        total[docs[lo:hi]] += weight[e] * impacts[lo:hi].astype(np.int64)
                    top = _best(total, ids, k)
                    for column, values in zip(out, (np.full(len(top), item[run[0]]), ids[top], total[top])):
                        column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["item_id", "doc_id", "score"])

    found = pairs.mapInArrow(scored, "item_id bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(items: DataFrame, docs: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Each item's k best documents: the index of docs is made and searched."""
    shards, n_docs = index(docs, shard_bytes)
    return search(items, shards, n_docs, k, block_entries)


def query(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL_TERMS = rf"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')"
ORACLE = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, unnest({_SQL_TERMS}) AS term FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY r),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM t GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, p.r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), c GROUP BY item_id, doc_id, p.r
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""

"""N-gram Jaccard self-join by partition of the universe and the pigeonhole principle.

A document is its set of distinct word shingles (64-bit hashes). Sets of like size share a size band; the hash
range, the universe, is cut into as many segments as the largest symmetric difference that two linked sets of a band can
have, plus one. A set's part in a segment is a subset that is indexed by its hash; of some designated segments
the one-deletion neighbourhood (the subset without one of its members) is indexed too.

Allocation, as in exact partition-based set joins: a probing set gives each segment 0 (not looked at), 1 (equal
subsets) or 2 (subsets that differ by one member at most); if the sum is at least the number of segments, no linked
partner is missed. Empty subsets, which random sets share, cost most and get 0; designated segments get 2 to pay for
it. How many are designated follows from the data, band by band, so that every document can pay; one that
can't looks its empty segments up after all.

Equal sets are collapsed first. Index entries go to ranges of bounded size in packed blocks (sorted keys as
differences, in byte planes); a key that a third of all documents share fills ranges of its own and is dealt over them by
document. First the members of each entry are tied to one of them, the one whose
entries are shared most (a star, not all pairs); verification and components follow. Entries within one component
are done. Of the rest, those of FREQUENT members at most give their pairs of different components. Documents with more
frequent entries are indexed again, with one-deletion neighbourhoods in all segments: one that can pay for giving
up all its frequent entries does, and its partners are found by its other entries. Frequent entries give pairs only of
documents that can't, less those that have too much that no other component has (an edit of a common text leaves such
shingles), since that is in no intersection. Verification rejects by sketches of parities, whose differences bound the symmetric
difference from below, and compares the whole sets of the pairs that are left.

Defined results: null or empty text, or one without words, has no shingles and links with nothing; repeated rows and
equal sets are linked; a repeated doc_id is one vertex; a null doc_id links with nothing and has a null component; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm.common import materialise, own_names, remove_table, small_or_whole, tables
from tessellon.llm.components import components

WORDS, PERCENT = 4, 85
FREQUENT = 16
#: Classes of shingles by the logarithm of their frequency, for an upper bound of intersections.
CLASSES = 12
#: Entries of sampled documents that the ranges are cut by, for each range; entries of a range, about; entries that a task sorts and packs at once.
RANGE_SAMPLE, RANGE, FLUSH = 40, 500_000, 250_000
#: Bits of a key beyond those that number all entries: a key meets one of other members by chance every 2 ** SPARE_BITS entries.
SPARE_BITS = 12


# ---- sets ------------------------------------------------------------------------------------------------------


def _mix(x):
    """64-bit finaliser over an unsigned array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None):
    """64-bit hash of every word, ASCII letters in lower case, in order."""
    import numpy as np

    if not text:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    gap = (a == 32) | ((a >= 9) & (a <= 13))
    at = np.flatnonzero(~gap)
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.concatenate([[True], at[1:] != at[:-1] + 1])
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(at)))
    place = np.arange(len(at)) - np.repeat(start, size)
    h = _mix((a[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _mix(np.add.reduceat(h, start) + size.astype(np.uint64))


def shingles(text: str | None, k: int = WORDS):
    """Sorted distinct hashes of the runs of k words; of all words if there are fewer."""
    import numpy as np

    w = word_hashes(text)
    if not len(w):
        return w
    m = np.uint64(0x9E3779B97F4A7C15)
    if len(w) < k:
        h = np.uint64(len(w)) * np.ones(1, np.uint64)
        for x in w:
            h = _mix(h * m + x)
        return h
    h = np.full(len(w) - k + 1, 7, np.uint64)
    for j in range(k):
        h = _mix(h * m + w[j : j + len(h)])
    return np.unique(h)


# ---- bands -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def bands(percent: int = PERCENT) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Largest set size of each band, and the number of segments for pairs whose smaller set is in it. A partner's band is the same or the next."""
    tops, segments, top = [], [], 1
    while top < 1 << 40:
        tops.append(top)
        far = top + top * 100 // percent
        most = max(t - 2 * -(-percent * t // (100 + percent)) for t in (far - 1, far))
        segments.append(max(0, most) + 1)
        top = max(top + 1, top * 100 // percent)
    return tuple(tops), tuple(segments)


def band_of(n: int, percent: int = PERCENT) -> int:
    from bisect import bisect_left

    return bisect_left(bands(percent)[0], n)


def _segments(s, m: int):
    """For a sorted set: the segments that it has members in, where they begin, how many there are."""
    import numpy as np

    seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    return seg[start].astype(np.int64), start, np.diff(np.append(start, len(s)))


def need_of(seg, size, m: int) -> int:
    """How many first segments must be designated for this set to pay for its empty segments; -1 if it can't."""
    import numpy as np

    able, empty = np.sort(seg[size >= 2]), m - len(seg)
    if empty > len(able):
        return -1
    return int(able[empty - 1]) + 1 if empty else 0


# meta bits of an index entry, below its 60-bit hash
DELETED, UPPER, DESIGNATED, EMPTY = 1, 2, 4, 8


def entries(s, scheme: int, m: int, upper: bool, designated: int, empties: bool):
    """Index entries (hash and meta bits in 64) of a sorted set under a scheme."""
    import numpy as np

    seg, start, size = _segments(s, m)
    part = _mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    whole = np.add.reduceat(part, start)
    of_scheme = np.uint64(scheme * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    salt = _mix(seg.astype(np.uint64) + of_scheme)
    up = UPPER if upper else 0
    strip = np.uint64(0xFFFFFFFFFFFFFFF0)
    own = seg < designated
    out = [(_mix(whole + salt) & strip) | np.where(own & (size >= 2), np.uint64(up | DESIGNATED), np.uint64(up))]
    many = np.flatnonzero(own & (size >= 2))
    if len(many):
        which = np.repeat(many, size[many])
        at = np.concatenate([np.arange(start[i], start[i] + size[i]) for i in many])
        out.append((_mix(whole[which] - part[at] + salt[which]) & strip) | np.uint64(up | DELETED))
    if empties:
        none = np.setdiff1d(np.arange(m), seg)
        salt = _mix(none.astype(np.uint64) + of_scheme)
        out.append((_mix(salt) & strip) | np.uint64(up | EMPTY))
    return np.concatenate(out)


# ---- the join --------------------------------------------------------------------------------------------------


def _profiles(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """doc, n, k1, k2 (a 128-bit name of the set), and for its own and the lower scheme: needed designated segments (-1: can't pay)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        segs = bands(percent)[1]
        for b in batches:
            rows = []
            for t in b.column(1):
                s = shingles(t.as_py(), words)
                if not len(s):
                    rows.append((0, 0, 0, 0, 0, 0))
                    continue
                band = band_of(len(s), percent)
                k1, k2 = np.add.reduce(_mix(s)), np.add.reduce(_mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)))
                got = []
                for scheme in (band, band - 1):
                    m = segs[scheme] if scheme >= 0 else 1
                    if m == 1:
                        got.append(0)
                        continue
                    seg, _, size = _segments(s, m)
                    got.append(need_of(seg, size, m))
                rows.append((len(s), int(k1.astype(np.int64)), int(k2.astype(np.int64)), band, *got))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc", "n", "k1", "k2", "band", "need", "need_low"])

    return docs.mapInArrow(run, "doc bigint, n bigint, k1 bigint, k2 bigint, band int, need int, need_low int")


def _entries_of(docs: DataFrame, percent: int, words: int, designated: dict | None, poor: set, bits: int = 64, cuts=None) -> DataFrame:
    """Every document's entries under its own scheme and the one below (designated None: all segments). The upper 60 bits of an entry are its key, of which the first ``bits`` - 4 are
    kept, so that equal keys stay equal and a few others become so; the lower 4 are its meta bits. Without cuts: rows of one entry. With cuts: range, block, where a block packs a range's sorted entries."""

    def groups(batches):
        import numpy as np

        segs = bands(percent)[1]
        keys, ids, held = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(text.as_py(), words)
                if not len(s):
                    continue
                band = band_of(len(s), percent)
                for scheme in (band, band - 1):
                    if scheme >= 0 and segs[scheme] > 1:
                        d = segs[scheme] if designated is None else designated.get(scheme, 0)
                        keys.append(_kept_bits(entries(s, scheme, segs[scheme], scheme < band, d, scheme in poor), bits))
                        ids.append(np.full(len(keys[-1]), doc, np.int64))
                        held += len(keys[-1])
                if held > FLUSH:
                    yield np.concatenate(keys), np.concatenate(ids)
                    keys, ids, held = [], [], 0
        if keys:
            yield np.concatenate(keys), np.concatenate(ids)

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for key, _ in groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["entry"])

    def blocks(batches):
        import numpy as np
        import pyarrow as pa

        for key, doc in groups(batches):
            # a key that fills several ranges is dealt over them by document
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            at = np.searchsorted(cuts, key >> np.uint64(4), "left")
            if len(cuts) and len(on := np.flatnonzero(cuts[np.minimum(at, len(cuts) - 1)] == key >> np.uint64(4))):
                last = np.searchsorted(cuts, key[on] >> np.uint64(4), "right")
                share = (doc[on].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                at[on] += (share % (last - at[on] + 1).astype(np.uint64)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            key, doc, at = key[order], doc[order], at[order]
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            parts = list(zip(start, [*start[1:], len(at)]))
            for i in range(0, len(parts), 64):
                packed = [pack(key[x:y], doc[x:y]) for x, y in parts[i : i + 64]]
                yield pa.RecordBatch.from_arrays([pa.array([int(at[x]) for x, _ in parts[i : i + 64]], pa.int32()), pa.array(packed, pa.binary())], names=["range", "block"])

    return docs.mapInArrow(rows, "entry bigint") if cuts is None else docs.mapInArrow(blocks, "range int, block binary")


def _kept_bits(entry, bits: int):
    """The entry with the first bits - 4 bits of its key, moved down, and its meta bits."""
    import numpy as np

    return (entry >> np.uint64(68 - bits) << np.uint64(4)) | (entry & np.uint64(15)) if bits < 64 else entry


def _planes(x) -> bytes:
    """Unsigned 64-bit numbers as byte planes, without those that hold nothing but zeros: a byte that tells which are there, then the planes."""
    import numpy as np

    planes = x.view(np.uint8).reshape(-1, 8).T
    there = [i for i in range(8) if planes[i].any()]
    return bytes([sum(1 << i for i in there)]) + b"".join(planes[i].tobytes() for i in there)


def pack(key, doc) -> bytes:
    """A block of sorted entries: their number, the differences of neighbouring keys and the documents."""
    import numpy as np

    return len(key).to_bytes(4, "little") + _planes(np.diff(key, prepend=np.uint64(0))) + _planes(np.ascontiguousarray(doc).view(np.uint64))


def unpack(block: bytes):
    import numpy as np

    n, at, out = int.from_bytes(block[:4], "little"), 4, []
    for _ in range(2):
        x = np.zeros((n, 8), np.uint8)
        there, at = block[at], at + 1
        for i in range(8):
            if there >> i & 1:
                x[:, i] = np.frombuffer(block, np.uint8, n, at)
                at += n
        out.append(x.view(np.uint64).ravel())
    return np.cumsum(out[0], dtype=np.uint64), out[1].view(np.int64)


def _indexed(docs: DataFrame, profile: DataFrame, percent: int, words: int, designated: dict | None, poor: set, name: str) -> DataFrame:
    """key, meta, doc of the entries that could hold a candidate pair, found range by range. The ranges are cut by the entries of every so manyth document, and hold about RANGE entries at most."""
    import numpy as np

    spark = docs.sparkSession
    segs = bands(percent)[1]
    # entries of a document, about: one a segment under each scheme, and its members once more where all segments are designated
    weight = 2 * F.array(*(F.lit(m) for m in segs))[F.col("band")] + (2 * F.col("n") if designated is None else F.lit(0))
    whole = profile.where("n > 0").agg(F.sum(weight)).first()[0] or 0
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // RANGE))
    bits = min(64, whole.bit_length() + SPARE_BITS + 4)
    every = max(1, whole // (ranges * RANGE_SAMPLE))
    some = docs.where(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0)
    sample = np.sort(np.asarray(_entries_of(some, percent, words, designated, poor, bits).toArrow()["entry"].combine_chunks()).view(np.uint64)) >> np.uint64(4)
    cuts = sample[np.linspace(0, len(sample), ranges + 1).astype(int)[1:-1]] if len(sample) >= ranges else np.zeros(0, np.uint64)
    dealt = _entries_of(docs, percent, words, designated, poor, bits, cuts).repartitionById(ranges, "range").select("block")
    return materialise(dealt.mapInArrow(_runs(cuts), "key bigint, meta int, doc bigint"), name)


def _runs(cuts):
    """The entries of runs of equal keys that could hold a candidate pair. A key that is dealt over several ranges is kept in each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts = [unpack(x.as_py()) for b in batches for x in b.column(0)]  # about RANGE entries
        if not parts:
            return
        e, d = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.argsort(e)
        e, d = e[order], d[order]
        key, meta = e >> np.uint64(4), e.astype(np.uint8) & 15
        del order, e
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        whole = np.add.reduceat((meta & DELETED) == 0, start, dtype=np.int64)
        lower = np.add.reduceat((meta & UPPER) == 0, start, dtype=np.int64)
        ok = (size > 1) & (whole > 0) & (lower > 0)
        if len(cuts):
            ok |= np.isin(key[start], cuts)
        rows = np.flatnonzero(np.repeat(ok, size))
        for lo in range(0, len(rows), 100_000):
            at = rows[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(meta[at].astype(np.int32)), pa.array(d[at])], names=["key", "meta", "doc"])

    return run


def sketch(s):
    """Parities of how many members of a set fall in each of 4 to 8 buckets a member (a power of two), as bytes."""
    import numpy as np

    k = max(64, 4 << (len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((_mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(k - 1)).astype(np.int64), minlength=k) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, by their sketches: each bucket whose parities differ holds a member of it. The longer sketch is folded to the shorter one's buckets."""
    import numpy as np

    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _of_docs(docs: DataFrame, pairs: DataFrame, words: int, make, kind: str) -> DataFrame:
    """doc, n, and what make gives for its set (a column s of that kind), for every document of the pairs."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                sets = [shingles(t.as_py(), words) for t in b.column(1).slice(lo, 256)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), pa.array(list(map(len, sets)), pa.int64()), pa.array([make(x) for x in sets], pa.binary() if kind == "binary" else pa.list_(pa.int64()))], names=["doc", "n", "s"])

    ids = materialise(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), "jaccard-ids")
    return materialise(docs.join(small_or_whole(ids, 16), "doc", "left_semi").mapInArrow(run, f"doc bigint, n bigint, s {kind}"), "jaccard-sets")


def _joined_sets(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """a, b, na, sa, nb, sb."""
    a, b = (held.withColumnsRenamed({"doc": c, "n": f"n{c}", "s": f"s{c}"}) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "sa", "nb", "sb")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold. Sketches, a sixteenth as large, tell most pairs that don't; the whole sets of the others are compared."""

    def near(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            a_, b_, na, sa, nb, sb = (b.column(i) for i in range(6))
            n = np.asarray(na) + np.asarray(nb)
            gap = np.array([differ_at_least(x.as_py(), y.as_py()) for x, y in zip(sa, sb)], np.int64)
            # J >= p/100 means that the difference is at most (100 - p) / (100 + p) of both sizes
            ok = pa.array((100 + percent) * gap <= (100 - percent) * n)
            yield pa.RecordBatch.from_arrays([a_.filter(ok), b_.filter(ok)], names=["a", "b"])

    with tables(docs.sparkSession) as drop:
        small = _of_docs(docs, pairs, words, sketch, "binary")
        left = materialise(_joined_sets(pairs, small).mapInArrow(near, "a bigint, b bigint").distinct(), "jaccard-near")
        drop(left)
        held = _of_docs(docs, left, words, lambda x: x.view("int64"), "array<bigint>")
        both = F.size(F.array_intersect("sa", "sb"))
        links = _joined_sets(left, held).withColumn("both", both).where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")  # not made distinct, as Spark then couldn't split a star's pairs
        links = materialise(links, "jaccard-links")
        drop(links)
    return links


def _bit(bit: int):
    return F.col("meta").bitwiseAND(bit) > 0


def _mixed(rows: DataFrame, comp: DataFrame, name: str) -> DataFrame:
    """The entries whose members are of several components, with component and the number of members."""
    rows = rows.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("cnt"), F.count_if(~_bit(DELETED)).alias("whole"), F.count_if(~_bit(UPPER)).alias("lower"))
    mixed = materialise(mixed.where("lo <> hi and whole > 0 and lower > 0").select("key", "cnt"), "jaccard-mixed-keys")
    return materialise(rows.join(mixed, "key"), name)


def _near_size(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link."""
    n = sizes.select("doc", "n")
    sized = pairs.join(n.withColumnsRenamed({"doc": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"doc": "b", "n": "nb"}), "b")
    return sized.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")


def _stars(runs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of each entry's members with the one of them whose entries are shared most. What the rows of a frequent entry are joined with is written first, so that Spark can split the entry."""
    with tables(runs.sparkSession) as drop:
        count = materialise(runs.groupBy("key").agg(F.count("*").alias("cnt")), "jaccard-counts")
        weight = materialise(runs.where(~_bit(DELETED)).join(count, "key").groupBy("doc").agg(F.sum("cnt").alias("w")), "jaccard-weights")
        centre = runs.where(~_bit(DELETED)).join(weight, "doc").groupBy("key").agg(F.max(F.struct("w", (-F.col("doc")).alias("d"))).alias("c"))
        centre = materialise(centre.select("key", (-F.col("c.d")).alias("star")), "jaccard-centres")
        pairs = runs.join(centre, "key").where("doc <> star").select(F.least("doc", "star").alias("a"), F.greatest("doc", "star").alias("b")).distinct()
        out = materialise(_near_size(pairs, sizes, percent), "jaccard-stars")
        drop(out)
    return out


def _crossed(rows: DataFrame, keep: str) -> DataFrame:
    """Pairs (a, b) of different components within an entry. rows: key, doc, component, del, up and what keep asks for."""
    x, y = (rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "key")) for s in "xy")
    both = x.join(y, "key").where(f"doc_x < doc_y and component_x <> component_y and not (del_x and del_y) and not (up_x and up_y) and ({keep})")
    return both.select(F.col("doc_x").alias("a"), F.col("doc_y").alias("b")).distinct()


def _shared_enough(rows: DataFrame, lone: DataFrame, sizes: DataFrame, percent: int, words: int) -> DataFrame:
    """rows (key, doc, component, ..) of the documents that can still link within their entry, with n, common: members of their set that one of these documents in another component has too, and how many of them are in each class of frequency.

    What only one component has is in no intersection of two, so a pair's is at most the sum of the smaller counts of the classes; a document whose
    common is too small for the smallest set of its entry goes, and then entries that are left with one component.
    """

    def members(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                sets = [shingles(t.as_py(), words).view(np.int64) for t in b.column(1).slice(lo, 256)]
                ids = np.repeat(np.asarray(b.column(0).slice(lo, 256)), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["doc", "s"])

    ids = materialise(rows.select("doc", "component").distinct(), "jaccard-dear")
    each = lone.join(small_or_whole(ids.select("doc"), 16), "doc", "left_semi").mapInArrow(members, "doc bigint, s bigint")
    # a shingle of one component is told by its first and last component; the others are counted by how frequent they are
    places = each.join(small_or_whole(ids, 24), "doc").select("component", "doc", "s")
    shared = places.groupBy("s").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    shared = shared.select("s", F.least(F.lit(CLASSES - 1), F.floor(F.log2("df"))).alias("class"))
    counts = places.join(shared, "s").groupBy("doc").agg(*(F.count_if(F.col("class") == i).alias(f"c{i}") for i in range(CLASSES)))
    classes = [F.coalesce(f"c{i}", F.lit(0)).alias(f"c{i}") for i in range(CLASSES)]
    sized = ids.select("doc").distinct().join(sizes.select("doc", "n"), "doc").join(counts, "doc", "left").select("doc", "n", *classes)
    sized = sized.withColumn("common", sum((F.col(f"c{i}") for i in range(CLASSES)), F.lit(0)))
    rows = rows.join(materialise(sized, "jaccard-common"), "doc")
    least = rows.groupBy("key").agg(F.min("n").alias("least_n"))
    rows = rows.join(least, "key").where(f"{100 + percent} * common >= {percent} * (n + least_n)").drop("least_n")
    still = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return materialise(rows.join(still, "key"), "jaccard-dear-rows")


def _left_over(runs: DataFrame, lone: DataFrame, sizes: DataFrame, comp: DataFrame, done: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs of different components that are left to verify after the stars."""
    kinds = [_bit(DELETED).alias("del"), _bit(UPPER).alias("up"), _bit(EMPTY).alias("empty")]
    rows = _mixed(runs, comp, "jaccard-mixed")
    bands_of = sizes.select("doc", "band", "need", "need_low")
    cant = F.when(F.col("up"), F.col("need_low") < 0).otherwise(F.col("need") < 0)
    few = rows.where((F.col("cnt") <= FREQUENT) | _bit(EMPTY)).select("key", "doc", "component", *kinds)
    few = few.join(bands_of, "doc").select("key", "doc", "component", "del", "up", "empty", cant.alias("poor"))
    pairs = _crossed(few, "not (empty_x and empty_y) or poor_x or poor_y")
    hot = materialise(rows.where((F.col("cnt") > FREQUENT) & ~_bit(EMPTY)).select("doc").distinct(), "jaccard-hot")
    if hot.isEmpty():
        return materialise(_near_size(pairs, sizes, percent).join(done, ["a", "b"], "left_anti"), "jaccard-pairs")
    # documents with frequent entries once more, with every one-deletion neighbourhood
    again = lone.join(small_or_whole(hot, 16), "doc", "left_semi")
    full = _mixed(_indexed(again, sizes.join(hot, "doc", "left_semi"), percent, words, None, set(), "jaccard-again"), comp, "jaccard-mixed")
    frequent = F.col("cnt") > FREQUENT
    # what a document can give up: its segments with two members or more, less those that a frequent entry touches, less its empty ones
    spent = full.where(frequent).groupBy("doc", _bit(UPPER).alias("up")).agg(F.count_if(~_bit(DELETED)).alias("whole"), F.count_if(_bit(DESIGNATED) | _bit(DELETED)).alias("touched"))
    able = lone.join(small_or_whole(hot, 16), "doc", "left_semi").mapInArrow(_able(percent, words), "doc bigint, up boolean, able int, empty int").dropDuplicates(["doc", "up"])
    pays = materialise(spent.join(able, ["doc", "up"]).select("doc", "up", (F.col("whole") + F.col("empty") <= F.col("able") - F.col("touched")).alias("pays")), "jaccard-pays")
    full = full.select("key", "doc", "component", "cnt", *kinds).join(pays, ["doc", "up"], "left").withColumn("pays", F.coalesce("pays", F.lit(True)))
    cheap = _crossed(full.where("cnt <= %d" % FREQUENT).drop("cnt", "pays", "empty"), "true")
    dear = _crossed(_shared_enough(full.where("cnt > %d and not pays" % FREQUENT).drop("cnt", "pays", "empty"), lone, sizes, percent, words), f"{100 + percent} * ({' + '.join(f'least(c{i}_x, c{i}_y)' for i in range(CLASSES))}) >= {percent} * (n_x + n_y)")
    pairs = pairs.unionByName(cheap).unionByName(dear).distinct()
    return materialise(_near_size(pairs, sizes, percent).join(done, ["a", "b"], "left_anti"), "jaccard-pairs")


def _able(percent: int, words: int):
    """For each document and scheme: segments that can get a 2, and empty ones."""

    def run(batches):
        import pyarrow as pa

        segs = bands(percent)[1]
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(text.as_py(), words)
                if not len(s):
                    continue
                band = band_of(len(s), percent)
                for scheme in (band, band - 1):
                    if scheme >= 0 and segs[scheme] > 1:
                        seg, _, size = _segments(s, segs[scheme])
                        rows.append((doc, scheme < band, int((size >= 2).sum()), segs[scheme] - len(seg)))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.bool_(), pa.int32(), pa.int32()))], names=["doc", "up", "able", "empty"])

    return run


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int, words: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    profile = materialise(_profiles(rows, percent, words), "jaccard-profiles")
    own = profile.select(F.col("band").alias("scheme"), "need", "n")
    low = profile.select((F.col("band") - 1).alias("scheme"), F.col("need_low").alias("need"), "n")
    told = own.unionByName(low).where("n > 0 and scheme >= 0").groupBy("scheme").agg(F.max("need").alias("need"), F.min("need").alias("least")).collect()  # a row per band: some 250 at most
    designated = {r["scheme"]: max(0, r["need"]) for r in told}
    poor = {r["scheme"] for r in told if r["least"] < 0}
    # equal sets: the smallest id stands for all
    same = materialise(profile.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc").alias("rep"), F.max("doc").alias("top")).where("top > rep").drop("top"), "jaccard-equal")
    copies = materialise(profile.where("n > 0").join(same, ["n", "k1", "k2"]).where("doc <> rep").select("doc", "rep").distinct(), "jaccard-copies")
    lone = rows.join(small_or_whole(copies.select("doc"), 16), "doc", "left_anti")
    sizes = materialise(profile.where("n > 0").dropDuplicates(["doc"]), "jaccard-sizes")
    runs = _indexed(lone, sizes, percent, words, designated, poor, "jaccard-runs")
    stars = _stars(runs, sizes, percent)
    links = _verified(stars, lone, percent, words)
    with tables(docs.sparkSession) as drop:
        more = _left_over(runs, lone, sizes, components(links), stars, percent, words)
        drop(more)
    remove_table(runs)
    remove_table(stars)
    if not more.isEmpty():
        links = links.unionByName(_verified(more, lone, percent, words))
    comp = components(links.unionByName(copies.select(F.col("doc").alias("a"), F.col("rep").alias("b"))))
    return profile.select("doc", "n").join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc, n, component for every row of docs with a non-null id; linked documents share the component, the smallest id among them. A written table; all others that it took are deleted."""
    with tables(docs.sparkSession) as drop:
        found = materialise(_linked(docs, id_col, text_col, percent, words), "jaccard-linked")
        drop(found)
    return found


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs, rows with a null id included."""
    found = linked(docs, id_col, text_col, percent, words).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    nameless = _profiles(docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")), percent, words)
    return found.unionByName(nameless.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of docs without near copies: of each group of linked documents the one with the smallest doc_id stays, and of its repeated rows one."""
    found = linked(docs, percent=percent, words=words)
    gone = found.where("component <> doc").select("doc").distinct()
    gone = materialise(gone, "jaccard-gone")
    repeated = materialise(found.groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").select("doc"), "jaccard-repeated")
    (doc,) = own_names(docs.columns, "doc")
    rows = docs.withColumn(doc, F.col("doc_id").cast("bigint"))
    rows = rows.join(small_or_whole(gone.withColumnRenamed("doc", doc), 16), doc, "left_anti")
    again = small_or_whole(repeated.withColumnRenamed("doc", doc), 16)
    (i,) = own_names(rows.columns, "i")
    once = rows.join(again, doc, "left_semi").withColumn(i, F.row_number().over(Window.partitionBy(doc).orderBy(F.xxhash64("text")))).where(F.col(i) == 1).drop(i)
    return rows.join(again, doc, "left_anti").unionByName(once).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id"""

"""Language identification by nearest centroid.

A text's letters (lower case, everything else one space) give 1- to 3-gram counts hashed into a fixed number of
dimensions; damped counts times inverse document frequency, normalised, are compared by cosine with several
centroids per language; centroids that few rows gather at are dropped. The best centroid names the language. A text
is rejected when its distance from that centroid is above the language's limit, or when less of it than the language's
least share is made of n-grams known there. Both limits come from the bulk of the language's own rows, within bounds.

The classifier is fitted on a bounded sample of labelled rows: of the ``most_langs`` most frequent languages ``per_lang``
to twice as many rows each, taken by a hash of the id, equal texts once; fewer only where a language has no more different ones. Prediction covers every
whole text. Each language is fitted by a task of its own; the driver gets the document frequency of each dimension, and of each
language its centroids and what it knows: sizes that parameters fix, whatever the rows.

Defined results: a null text or one without a letter gives ``und`` with score 0 and is rejected; with no labelled
rows at all every text gives ``und``; ties go to the language first in order; repeated rows give repeated results;
an empty table gives an empty table; extra columns pass through keep() and are ignored by predict().
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm.common import materialise, own_names

DIMS = 1 << 14
#: Centroids per language, and rows per language that they are fitted on (between this and twice this).
CENTROIDS, PER_LANG = 4, 400
#: Languages that a fit learns, the most frequent labels (of equally frequent ones the first in order); a bound of the fitted sample.
MAX_LANGS = 400
#: A language's limit: this many times the distance within which all but FAR of its own rows lie, within these bounds.
SLACK, FAR, MIN_DISTANCE, MAX_DISTANCE = 1.5, 0.05, 0.65, 0.7
#: Share of a language's rows that a centroid must be nearest to.
MIN_SHARE = 0.05
#: A language knows its most frequent n-grams that make up so much of its rows.
COVER = 0.98
#: A language's least known share: that of all but RARE of its own rows less MARGIN, within these bounds.
RARE, MARGIN, MIN_KNOWN, MAX_KNOWN = 0.05, 0.25, 0.6, 0.7
BATCH = 128


@lru_cache(maxsize=1)
def _letters():
    """For each code point of the basic plane its own number if it is a letter, else a space's."""
    import numpy as np

    t = np.full(1 << 16, 32, np.uint32)
    own = [c for c in range(1 << 16) if chr(c).isalpha()]
    t[own] = own
    return t


def grams(text: str | None):
    """Hashed n-grams of a text (an array of dimensions, with repeats), or None if it has no letter."""
    import numpy as np

    if not text:
        return None
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    high = cp > 0xFFFF
    if high.any():
        cp = cp.copy()
        far = {c: c if chr(c).isalpha() else 32 for c in np.unique(cp[high]).tolist()}
        cp[high] = [far[c] for c in cp[high].tolist()]
        low = ~high
        cp[low] = _letters()[cp[low]]
    else:
        cp = _letters()[cp]
    cp = np.concatenate([[32], cp, [32]])
    keep = (cp != 32) | np.concatenate([[True], cp[1:] != cp[:-1]])
    cp = cp[keep].astype(np.uint32)
    if len(cp) < 3:
        return None
    a, b, c = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
    one = cp * a
    two = (one[:-1] ^ (cp[1:] * b)) * c
    three = (two[:-1] ^ (cp[2:] * a)) * b
    shift = np.uint32(32 - int(math.log2(DIMS)))
    all_ = np.concatenate([one[cp != 32] * c, two, three])
    return (all_ ^ (all_ >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift


def _rows(counts):
    """Damped counts, row by row."""
    import numpy as np

    return np.log1p(counts, dtype=np.float32)


def sampled(known: DataFrame, sizes: dict[str, int], per_lang: int) -> DataFrame:
    """lang, h, doc_id, text of the rows that a fit learns from: at most twice per_lang a language."""
    every = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, max(1, n // per_lang))))
    sample = known.where(F.pmod(F.xxhash64(F.col("doc_id")), every[F.col("lang")]) == 0)  # a label that isn't learnt has no modulus and drops out
    # copies of a text count once, and an id that stands in many rows brings no more than the bound
    sample = sample.groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.min(F.struct("doc_id", "text")).alias("x")).select("lang", "h", "x.doc_id", "x.text")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "h"), "h")
    return sample.withColumn("i", F.row_number().over(first)).where(F.col("i") <= 2 * per_lang).drop("i")


def fit(docs: DataFrame, per_lang: int = PER_LANG, centroids: int = CENTROIDS, most_langs: int = MAX_LANGS) -> dict | None:
    """The classifier learnt from rows of docs (doc_id, text, lang) with a non-null lang; None if there are none."""
    import numpy as np

    known = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not sizes:
        return None
    sample = sampled(known, sizes, per_lang)

    def vectors(batches):
        import pandas as pd

        for pdf in batches:
            at, n = [], []
            for t in pdf["text"]:
                g = grams(t)
                u, k = np.unique(g, return_counts=True) if g is not None else ([], [])
                at.append(np.asarray(u, np.int32))
                n.append(np.asarray(k, np.int32))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "h": pdf["h"], "lang": pdf["lang"], "at": at, "n": n})

    got = materialise(sample.mapInPandas(vectors, "doc_id bigint, h string, lang string, at array<int>, n array<int>").where(F.size("at") > 0), "langid-sample")
    n_rows, df = got.count(), np.zeros(DIMS, np.int64)
    if not n_rows:
        return None
    for r in got.select(F.explode("at").alias("d")).groupBy("d").agg(F.count("*").alias("n")).collect():  # a row for each dimension at most
        df[r["d"]] = r["n"]
    idf = (np.log((1 + n_rows) / (1 + df)) + 1).astype(np.float32)

    def one(key, pdf):
        """The fit of one language: at most twice per_lang rows."""
        import pandas as pd

        part = pdf.sort_values(["doc_id", "h"], kind="stable")
        c, limit, mine, least = _language(part["at"], part["n"], idf, centroids)
        return pd.DataFrame({"lang": [key[0]] * len(c), "i": range(len(c)), "centroid": [x.tobytes() for x in c], "limit": limit, "known": [np.packbits(mine > 0).tobytes()] + [None] * (len(c) - 1), "least": least})

    told = got.groupBy("lang").applyInPandas(one, "lang string, i int, centroid binary, limit double, known binary, least double").orderBy("lang", "i").collect()
    f32 = lambda v: np.array(v, np.float32)
    langs = [r["lang"] for r in told]
    # one array a language, shared by its centroids and sent once
    known_by = {r["lang"]: np.unpackbits(np.frombuffer(r["known"], np.uint8)) for r in told if r["known"] is not None}
    return {"langs": langs, "centroids": np.stack([np.frombuffer(r["centroid"], np.float32) for r in told]), "idf": idf, "limits": f32([r["limit"] for r in told]), "known": [known_by[lang] for lang in langs], "least": f32([r["least"] for r in told])}


def _language(at, counts, idf, centroids: int):
    """Centroids, limit, known dimensions and least known share of one language, from its rows' dimensions and their counts."""
    import numpy as np

    x = np.zeros((len(at), DIMS), np.float32)
    for i, (a, k) in enumerate(zip(at, counts)):
        x[i, a] = np.log1p(k)
    mine = _known(x)
    share = x @ mine / x.sum(1)
    x *= idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, near = _clustered(x, min(centroids, len(x)))
    limit = min(MAX_DISTANCE, max(MIN_DISTANCE, SLACK * float(np.quantile(1 - near, 1 - FAR)) + 0.05))
    return c, limit, mine, min(MAX_KNOWN, max(MIN_KNOWN, float(np.quantile(share, RARE)) - MARGIN))


def _known(x):
    """1 for the dimensions that are in most rows, as many as make up COVER of the damped counts, else 0."""
    import numpy as np

    order = np.argsort(-(x > 0).sum(0), kind="stable")
    mass = np.cumsum(x.sum(0, dtype=np.float64)[order])
    out = np.zeros(x.shape[1], np.float32)
    out[order[: 1 + int(np.searchsorted(mass, COVER * mass[-1]))]] = 1
    return out


def _clustered(x, k: int, rounds: int = 12):
    """Spherical k-means; centroids and the cosine of each row with its nearest. Those with few rows go. It starts from rows spread evenly over the nearest 90 % to the mean, so no odd row gets a centroid of its own."""
    import numpy as np

    order = np.argsort(-(x @ x.mean(0)), kind="stable")[: max(k, int(0.9 * len(x)))]
    c = x[order[np.linspace(0, len(order) - 1, k).astype(int)]].copy()
    for _ in range(rounds):
        s = x @ c.T
        near = s.argmax(1)
        for i in range(k):
            if (own := near == i).any():
                m = x[own].sum(0)
                c[i] = m / np.linalg.norm(m)
    s = x @ c.T
    near = s.argmax(1)
    rows = np.bincount(near, minlength=k)
    used = np.flatnonzero(rows >= min(MIN_SHARE * len(x), rows.max()))
    return c[used], s[:, used].max(1)


def _predicted(docs: DataFrame, model: dict | None, text_col: str, keep: list[str], names: list[str]) -> DataFrame:
    """The kept columns of docs, and predicted language, score and rejected under the given names."""
    columns = [F.col(f"`{c}`") for c in keep]
    src = docs.select(*columns, F.col(f"`{text_col}`").alias(own_names(keep, "text_in")[0]))
    schema = src.select(*columns).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    # a fixed size: DIMS times (MAX_LANGS times CENTROIDS + 1) floats and MAX_LANGS times DIMS bytes at most
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        table = m and (m["centroids"] * m["idf"]).T.copy()
        for b in batches:
            langs, scores, rejected = [], [], []
            texts = b.column(len(keep))
            for lo in range(0, b.num_rows, BATCH):
                part = texts.slice(lo, BATCH).to_pylist()
                found = [grams(t) for t in part]
                x = np.zeros((len(part), DIMS), np.float32)
                for i, g in enumerate(found):
                    if g is not None:
                        x[i] = np.bincount(g, minlength=DIMS)
                if m is None:
                    langs += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    rejected += [True] * len(part)
                    continue
                x = _rows(x)
                s = x @ table
                size = np.sqrt((x * m["idf"]).__pow__(2).sum(1))
                s /= np.maximum(size, 1e-9)[:, None]
                best = s.argmax(1)
                share = np.array([x[i] @ m["known"][k] for i, k in enumerate(best)]) / np.maximum(x.sum(1), 1e-9)
                for i, k in enumerate(best.tolist()):
                    if found[i] is None:
                        langs.append("und")
                        scores.append(0.0)
                        rejected.append(True)
                        continue
                    v = min(1.0, max(0.0, float(s[i, k])))
                    langs.append(m["langs"][k])
                    scores.append(v)
                    rejected.append(bool(1 - v > m["limits"][k] or share[i] < m["least"][k]))
            cols = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], names=[*keep, *names])

    return src.mapInArrow(run, schema)


def held_out(doc_id="doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def predict(docs: DataFrame, model: dict | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, lang_pred, score, rejected for every row of docs."""
    return _predicted(docs, model, text_col, [id_col], ["lang_pred", "score", "rejected"])


def keep(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that the classifier, fitted on docs itself, doesn't reject; all their columns and no others."""
    names = own_names(docs.columns, "lang_pred", "score", "rejected")
    return _predicted(docs, fit(docs, **params), "text", docs.columns, names).where(~F.col(names[2])).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score", "rejected")

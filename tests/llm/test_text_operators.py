"""Operators that read texts one by one: tokens, quality, language, packing."""

import hashlib
import itertools
import math
import random
import zlib
import re

import pytest

from tessellon.llm import bpe, langid, packing, quality

ODD = ["", None, " \t\n", "one", "foo<|endoftext|>bar <|startoftext|>", "ΣΑΣ σας", "İstanbul it's I'LL we'd", "été ½ 漢字 👍🏽!!!", "a" * 5000, "aaaa!!!! aaaa", "\x00\x1c x y", "don't <|end"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def clashing(spark, rows, schema="doc_id bigint, text string, lang string, source string"):
    """The rows with extra columns whose names the operators could want for themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit(1) for c in ("n_words", "kept", "score", "rejected", "doc", "i", "o", "mu", "z0", "text_in", "lang_pred", "n")})


def test_bpe_equals_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i, t, "en", "s") for i, t in enumerate([*ODD, ODD[4]])]
    got = {r["doc_id"]: r for r in bpe.digests(clashing(spark, rows), path).collect()}
    full = {r["doc_id"]: r for r in bpe.encode(clashing(spark, rows), path).collect()}
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        said = lib.decode(ids, skip_special_tokens=False)
        assert full[i]["ids"] == ids and full[i]["decoded"] == said
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert bpe.digests(clashing(spark, rows).limit(0), path).count() == 0


def test_bpe_equals_merging_word_by_word(spark):
    P = pytest.importorskip("public_tokenizers")
    enc = bpe.encoder(P.path("word_bpe_49k.json"))
    random.seed(3)
    pieces = ["".join(random.choice("abcdeinrst") for _ in range(random.randint(1, 14))) for _ in range(400)] + ["aaaaaaa", "ababab"]
    ids, starts = enc.encode_pieces(pieces)
    for p, s, e in zip(pieces, starts, starts[1:]):
        own = [enc.vocab[c] for c in p[:-1]] + [enc.vocab[p[-1] + enc.end]]
        while ranks := [(enc.merges[k][0], i) for i in range(len(own) - 1) if (k := own[i] << 20 | own[i + 1]) in enc.merges]:
            _, i = min(ranks)
            own[i : i + 2] = [enc.merges[own[i] << 20 | own[i + 1]][1]]
        assert ids[s:e] == own


def stats_by_hand(text):
    w = words(text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_text_statistics():
    random.seed(1)
    texts = [*ODD, "a b\na b\n \n \nc a b\na b "]
    for _ in range(60):
        texts.append("".join(random.choice(["a", "b", "c", "#", "é"]) + random.choice([" ", " ", "\n", "\t"]) for _ in range(random.randint(1, 80))))
    for t in texts:
        assert quality.text_stats(t) == stats_by_hand(t), t


def corpus(n=240):
    random.seed(5)
    vocab = {"en": "the of and water house light river stone green walk quiet".split(), "de": "der die und wasser haus licht fluss stein gruen gehen ruhig".split()}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append((i, "\n".join(" ".join(random.choice(vocab[lang]) + random.choice(["", str(random.randint(0, 99))]) for _ in range(12)) for _ in range(random.randint(3, 12))), lang, f"s{i % 2}"))
    return rows


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    junk = [(1000 + k, "### $$$ %%% &&& *** |||" + " word##" * (60 + k) + " " + " ".join(f"x{j}$$" for j in range(60)), "en", "s1") for k in range(3)]
    odd = [(2000 + i, t, None, None) for i, t in enumerate(ODD)]
    docs = clashing(spark, corpus() + junk + odd + odd[:1])
    got = {r["doc_id"]: r for r in quality.verdicts(docs, min_group=20).collect()}
    for i, t, *_ in corpus() + junk + odd:
        assert tuple(got[i][c] for c in quality.STATS) == stats_by_hand(t)
        n, _, _, _, rep = stats_by_hand(t)
        assert got[i]["base_failed"] == (n < 20 or 100 * rep > 30 * n)
    assert all(got[i]["kept"] for i in range(240))
    assert not any(got[1000 + k]["kept"] for k in range(3))
    stay = quality.keep(docs, min_group=20)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(i for i, r in got.items() if r["kept"])
    assert quality.verdicts(docs.limit(0)).count() == 0


def test_quality_withstands_a_third_of_junk(spark):
    from pyspark.sql import functions as F

    random.seed(8)
    clean = [(i, t, "en", s) for s in ("own", "copies") for i, (_, t, *_) in enumerate(corpus(160), 1000 * (s == "copies"))]
    junk = [(5000 + k, " ".join(random.choice(["###", "$$$", "w#", "%%x", "&|"]) + str(random.randint(0, 999)) for _ in range(60 + 5 * k)), "en", "own") for k in range(80)]
    junk += [(6000 + k, junk[40][1], "en", "copies") for k in range(80)]
    got = {r["doc_id"]: r for r in quality.verdicts(spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(got[i]["kept"] or got[i]["base_failed"] for i, *_ in junk)
    assert all(got[i]["kept"] for i, *_ in clean)


def test_language_ties_and_many_labels(spark):
    rows = corpus(120)
    both = spark.createDataFrame([(2 * i + k, t, lang + x, s) for i, (_, t, lang, s) in enumerate(rows) for k, x in enumerate("ba")], "doc_id bigint, text string, lang string, source string")
    model = langid.fit(both)
    assert {r["lang_pred"] for r in langid.predict(both, model).collect()} == {"dea", "ena"}  # equal centroids: the first in order
    many = spark.createDataFrame([(i, t, lang, s) for i, t, lang, s in rows] + [(1000 + i, f"rare words {i}", f"x{i:03}", "s") for i in range(500)], "doc_id bigint, text string, lang string, source string")
    assert set(langid.fit(many, most_langs=5)["langs"]) == {"de", "en", "x000", "x001", "x002"}


def kept_by_hand(rows, min_group):
    """kept of each row (doc_id, text, lang, source): groups, starts, steps, choice by determinant and cut, with plain loops over whole groups."""
    import numpy as np

    q, floors = quality, np.array(quality.FLOORS)
    vectors, groups = {}, {}
    for i, (_, text, lang, source) in enumerate(rows):
        n, chars, symbols, dup, rep = stats_by_hand(text)
        if n >= 20 and 100 * rep <= 30 * n:
            vectors[i] = np.array([math.log(n), math.log(chars / n), math.log1p(100 * symbols / chars), math.log1p(dup), math.log1p(100 * rep / n)])
            groups.setdefault((lang, source), []).append(i)
    pools = {}
    for key, ids in groups.items():
        if len(ids) < min_group:
            pools.setdefault(key[0], []).extend(ids)
    final = [ids for ids in groups.values() if len(ids) >= min_group] + [ids for ids in pools.values() if len(ids) >= min_group]
    final.append([i for ids in pools.values() if len(ids) < min_group for i in ids])

    def upto(buckets, share):
        return sorted(buckets)[math.ceil(len(buckets) * share) - 1]

    def fit(x, scale=1.0):
        mu = x.mean(0)
        return mu, (np.einsum("ij,ik->jk", x, x) / len(x) - np.outer(mu, mu)) * scale + np.diag(floors**2)

    def step(x, est):
        d = np.einsum("ij,jk,ik->i", x - est[0], np.linalg.inv(est[1]), x - est[0])
        cell = np.floor(np.log2(np.maximum(d, 1e-12)) * q.PER_OCTAVE)
        return fit(x[cell <= upto(cell, q.H_SHARE)], q.CONSISTENCY)

    kept = [False] * len(rows)
    for ids in filter(None, final):
        x = np.array([vectors[i] for i in ids])
        w = floors / q.PER_FLOOR
        med = np.array([(upto(np.floor(x[:, k] / w[k]), 0.5) + 0.5) * w[k] for k in range(q.DIMS)])
        mad = np.array([(upto(np.floor(abs(x[:, k] - med[k]) / w[k]), 0.5) + 0.5) * w[k] for k in range(q.DIMS)])
        ests = [(med, np.diag((1.4826 * mad) ** 2 + floors**2)), fit(x)]
        near = (abs(x - med) <= 2 * 1.4826 * mad + floors).all(1)
        ests += [fit(x[near])] if near.any() else []
        for _ in range(q.SCREEN):
            ests = [step(x, e) for e in ests]
        best = min(ests, key=lambda e: np.linalg.det(e[1]))
        while np.linalg.det((then := step(x, best))[1]) < np.linalg.det(best[1]) * (1 - q.SHRINK):
            best = then
        for i, v in zip(ids, x):
            kept[i] = bool((v - best[0]) @ np.linalg.inv(best[1]) @ (v - best[0]) <= q.CUT)
    return kept


def test_quality_equals_plain_loops(spark):
    """Whole verdicts, with a group of its own, groups pooled by language, and the rest pooled with all others; a third of one group is junk."""
    random.seed(12)
    rows = [(i, t, lang, s) for i, (_, t, lang, s) in enumerate(corpus(240))]
    rows += [(1000 + i, t, lang, f"small{i % 5}") for i, (_, t, lang, _) in enumerate(corpus(60))]
    rows += [(2000 + i, t, f"rare{i % 7}", None) for i, (_, t, _, _) in enumerate(corpus(40))]
    rows += [(3000 + i, " ".join(random.choice(["###", "$$$", "w#"]) + str(random.randint(0, 999)) for _ in range(50 + 3 * i)), "en", "s0") for i in range(40)]
    rows += [(4000 + i, " ".join(f"{'longer' * random.randint(1, 9)}{random.randint(0, 99)}" for _ in range(80)), f"rare{i}", "x") for i in range(3)]
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), min_group=20).collect()}
    want = kept_by_hand(rows, 20)
    assert [got[r[0]] for r in rows] == want
    assert 40 <= sum(not k for k in want) < 60


def test_the_start_with_the_smallest_determinant_wins(spark):
    """The estimate is a fixed point, and its determinant is no larger than what the first steps from any start give."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, quality.DIMS))
    x[:60] += 8
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"z{i} double" for i in range(quality.DIMS)))
    est = quality._estimates(df).first()
    now = quality._starts(df)
    assert now.count() == quality.STARTS
    for _ in range(quality.SCREEN):
        now = quality._concentrated(df, now)
    assert est["det"] <= min(r["det"] for r in now.collect())
    again = quality._concentrated(df, spark.createDataFrame([est]).selectExpr("g", "cast(k as int) as k", "mu", "inv", "det")).first()
    assert again["det"] >= est["det"] * (1 - 1e-6)
    assert np.linalg.norm(est["mu"]) < 0.5


def test_chi_square():
    assert abs(quality.chi2_sf(11.0705, 5) - 0.05) < 1e-5 and abs(quality.chi2_sf(5.99146, 2) - 0.05) < 1e-5
    assert abs(quality.chi2_quantile(0.05, 5) - 11.0705) < 1e-3


def test_language(spark):
    docs = clashing(spark, corpus() + [(1000 + i, t, None, None) for i, t in enumerate(ODD)] + [(2000, "qqqq xxxx zzzz jjjj vvvv kkkk", None, None)])
    model = langid.fit(docs.where(~langid.held_out()), per_lang=50)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    held = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 30
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in held) >= 0.98 * len(held)
    for i, t in enumerate(ODD):
        blank = not any(c.isalpha() for c in t or "")
        assert (got[1000 + i]["lang_pred"] == "und") == blank
        assert 0 <= got[1000 + i]["score"] <= 1 and (not blank or got[1000 + i]["score"] == 0)
    assert got[2000]["rejected"] and not any(got[i]["rejected"] for i in range(240))
    kept = langid.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(240))
    assert langid.predict(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs.where("doc_id >= 1000"))).collect()} == {"und"}


WORDS = {
    "en": "the of and to in that was his with for had which not were from have this they their would there been when who will more if out said what about time some only other new could these two may first then any my now such like our over even most made after also did many before must through years where much your way well down should because each just those people too good".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei diese wieder keine uhr".split(),
    "it": "che di la il un una per non sono mi si lo ho ma ti ha cosa le con no hai bene tutto della come se qui questo lei sei del era gli perché anche quando più mio fare al essere stato quello io so mia ne tu solo niente ora voglio chi ci dove molto suo ancora tempo detto uomo loro nostra casa vita prima sempre abbiamo fatto andare grazie signore".split(),
    "fi": "on ei ja hän se että oli mutta niin kun minä sinä mitä tämä olen kuin nyt vain jos hyvä kaikki sen olla minun myös kanssa ovat miten tule mennä joka ollut kyllä sitä joku täällä koska aina vielä hänen meidän olet takaisin jotain voi mies haluan tiedän pitää sanoi ehkä todella kotiin vuotta ihmiset koskaan paljon".split(),
}


def spoken(lang, n, least, most, first=0):
    rng = random.Random(f"{lang} {first}")
    return [(first + i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(least, most)))) for i in range(n)]


def test_unlabelled_languages_are_rejected(spark):
    own = [(i + k, t, lang, "s") for k, lang in ((0, "en"), (10_000, "de")) for i, t in spoken(lang, 300, 20, 60)]
    own += [(i + k, t.upper() if i % 2 else t, lang, "s") for k, lang in ((0, "en"), (10_000, "de")) for i, t in spoken(lang, 8, 1, 2, 5000)]
    new = [(i + k, t, lang, "s") for k, lang in ((0, "en"), (10_000, "de")) for i, t in spoken(lang, 100, 20, 60, 7000)]
    code = "for row in batches: yield pa.RecordBatch.from_arrays([row.column(k) for k in range(len(keep))]); raise ValueError(msg) if not isinstance(obj, str) else None"
    far = [(i + k, t, None, None) for k, lang in ((20_000, "it"), (30_000, "fi")) for i, t in spoken(lang, 100, 20, 60)] + [(40_000, code, None, None), (40_001, "qzx jkw vvq " * 20, None, None)]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    model = langid.fit(docs(own))
    got = {r["doc_id"]: r for r in langid.predict(docs(new + far), model).collect()}
    assert sum(got[i]["rejected"] for i, *_ in new) <= 2
    assert sum(not got[i]["rejected"] for i, *_ in far) <= 2 and got[40_000]["rejected"] and got[40_001]["rejected"]


def test_language_by_hand(spark):
    import corpus_pipeline
    import numpy as np

    rows = [(i + k, t, lang, "s") for k, lang in ((0, "en"), (10_000, "de")) for i, t in spoken(lang, 120, 5, 40)]
    asked = [(i + 20_000, t, None, None) for i, t in spoken("it", 20, 5, 40)]
    docs = lambda x: spark.createDataFrame(x, "doc_id bigint, text string, lang string, source string")
    model = langid.fit(docs(rows))
    asked = rows + asked
    got = {r["doc_id"]: r for r in langid.predict(docs(asked), model).collect()}
    stays = set()
    vectors = {}
    for i, t, lang, _ in asked:
        v = np.zeros(langid.DIMS)
        for g in langid.grams(t):
            v[g] += 1
        vectors[i] = np.log(1 + v)
    idf = np.log((1 + len(rows)) / (1 + sum(vectors[i] > 0 for i, *_ in rows))) + 1
    unit = {i: v * idf / np.linalg.norm(v * idf) for i, v in vectors.items()}
    assert np.allclose(idf, model["idf"], rtol=1e-4)
    for lang in ("de", "en"):
        at = [k for k, name in enumerate(model["langs"]) if name == lang]
        own = [i for i, _, name, _ in rows if name == lang]
        near = {i: max(at, key=lambda k: unit[i] @ model["centroids"][k]) for i in own}
        assert min(sum(k == m for m in near.values()) for k in at) >= langid.MIN_SHARE * len(own) / 2
        far = np.quantile([1 - unit[i] @ model["centroids"][near[i]] for i in own], 1 - langid.FAR)
        df = {d: sum(vectors[i][d] > 0 for i in own) for d in range(langid.DIMS) if any(vectors[i][d] > 0 for i in own)}
        mass = {d: sum(vectors[i][d] for i in own) for d in df}
        known, total = set(), 0.0
        for d in sorted(df, key=lambda d: (-df[d], d)):
            known.add(d)
            total += mass[d]
            if total >= langid.COVER * sum(mass.values()):
                break
        for k in at:
            assert abs(model["limits"][k] - min(langid.MAX_DISTANCE, max(langid.MIN_DISTANCE, langid.SLACK * far + 0.05))) < 1e-3
            assert len(known ^ set(np.flatnonzero(model["known"][k]).tolist())) <= 1
    for i, *_ in asked:
        cos = model["centroids"] @ unit[i]
        k = int(cos.argmax())
        share = vectors[i] @ model["known"][k] / vectors[i].sum()
        assert got[i]["lang_pred"] == model["langs"][k] and abs(got[i]["score"] - cos[k]) < 1e-4
        assert got[i]["rejected"] == (1 - cos[k] > model["limits"][k] or share < model["least"][k])
        stays |= set() if got[i]["rejected"] else {i}
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs(asked), "").collect()} == stays and len(stays) < len(asked)


def test_boundaries_are_optimal():
    random.seed(1)
    for _ in range(150):
        m = random.randint(1, 8)
        lengths, counts, k = random.sample(range(40), m), [random.randint(1, 9) for _ in range(m)], random.randint(1, 4)

        def cost(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))

        got = packing.boundaries(lengths, counts, k)
        best = min(cost({*s, max(lengths)}) for r in range(k) for s in itertools.combinations(lengths, r))
        assert len(got) <= k and cost(got) == best


def test_packing_is_whole_and_within_budget(spark):
    rows = corpus(90) + [(1000 + i, t, None, None) for i, t in enumerate(ODD)] + [(1, corpus(2)[1][1], "en", "s1"), (None, "a b c", None, None)]
    docs = clashing(spark, rows)
    got = packing.packed(docs, max_tokens=30, buckets=4, token_budget=100).collect()
    by_doc, slots, sizes = {}, set(), {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert r["n_tokens"] <= r["bucket_tokens"] <= 30
        assert (r["batch_id"], r["slot"]) not in slots
        slots.add((r["batch_id"], r["slot"]))
        sizes[r["batch_id"]] = sizes.get(r["batch_id"], 0) + r["bucket_tokens"]
    assert max(sizes.values()) <= 100
    want = {}
    for i, t, *_ in rows:
        want[i] = want.get(i, 0) + len(words(t))
    assert {i: sum(r["n_tokens"] for r in rs) for i, rs in by_doc.items()} == want
    again = packing.packed(docs.repartition(7), max_tokens=30, buckets=4, token_budget=100).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert packing.packed(docs.limit(0)).count() == 0

"""Operators that compare rows with each other: search, near duplicates, URL lists, quotations."""

import math
import random
import re

import duckdb
import pytest

from tessellon.llm import chat, jaccard, urlfilter, voronoi
from tessellon.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(rows, k, percent):
    """Component of each id by comparing all pairs."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i in parent}


def varied(seed, n, vocab=2000):
    """Texts of many sizes with copies, near copies at all distances, chains and shared passages."""
    random.seed(seed)
    word = lambda: f"w{random.randint(0, vocab)}"
    shared = " ".join(word() for _ in range(30))
    rows = []
    for i in range(n):
        kind = random.random()
        if i < 10 or kind < 0.35:
            w = [word() for _ in range(int(math.exp(random.uniform(0, 5.2))))]
            if random.random() < 0.3:
                w = shared.split() + w
        else:
            w = random.choice(rows[-60:])[1].split()
            for _ in range(random.randint(0, max(1, len(w) // 25))):
                at = random.randint(0, len(w))
                w[at : at + random.randint(0, 1)] = [word()] * random.randint(0, 1)
        rows.append((i, " ".join(w)))
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_near_duplicates_equal_all_pairs(spark, k, percent, seed):
    rows = varied(seed, 500) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "Only Two"), (9004, "only two"), (9005, "x " * 4000), (9006, "X " * 4100)]
    docs = spark.createDataFrame(rows + [rows[0], (None, "a b c d e f")], "doc_id bigint, text string").selectExpr("*", "1 as doc", "2 as n", "3 as component", "4 as i")
    got = jaccard.joined(docs, words=k, percent=percent).collect()
    want = groups(rows, k, percent)
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["n_shingles"] == len(shingles(dict(rows)[r["doc_id"]], k))
    kept = jaccard.keep_one(docs, words=k, percent=percent)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert jaccard.joined(docs.limit(0)).count() == 0


def test_frequent_subsets_lose_no_link(spark, monkeypatch):
    """With a low limit nearly every entry is a costly one that is given up as far as it is paid for."""
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    rows = varied(7, 300, vocab=60)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == groups(rows, 4, 85)


def test_blocks_and_sketches():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        key, doc = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)), rng.integers(-5, 1 << 40, n)
        k, d = jaccard.unpack(jaccard.pack(key, doc))
        assert (k == key).all() and (d == doc).all()
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, int(np.exp(rng.uniform(0, 7)))).astype(np.uint64))
        y = np.unique(np.concatenate([x[int(rng.integers(0, len(x) + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 60))).astype(np.uint64)]))
        gap = len(np.setxor1d(x, y))
        assert jaccard.differ_at_least(jaccard.sketch(x), jaccard.sketch(y)) <= gap
        if gap * 4 < len(x):  # what is near the threshold is bounded closely
            assert jaccard.differ_at_least(jaccard.sketch(y), jaccard.sketch(x)) >= gap * 3 // 4 - 4


def test_a_hub_is_joined_where_its_edges_are(spark, monkeypatch):
    """A star of 10,000 members, another and a chain: the same components whatever the number of broadcast hubs."""
    from tessellon.llm import components as m

    edges = [(7, 100 + i) for i in range(10_000)] + [(20_000, 30_000 + i) for i in range(300)] + [(40_000 + i, 40_001 + i) for i in range(40)] + [(5, 100)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    want = {r: 5 for r in (5, 7, *range(100, 10_100))} | {r: 20_000 for r in (20_000, *range(30_000, 30_300))} | {r: 40_000 for r in range(40_000, 40_041)}
    for hubs in (1000, 2):
        monkeypatch.setattr(m, "HUBS", hubs)
        assert dict(map(tuple, components(df).collect())) == want


def test_allocation_pays():
    """No two sets within the threshold lack a common entry, whatever their empty segments."""
    import numpy as np

    rng = np.random.default_rng(1)
    tops, segs = jaccard.bands()
    for _ in range(400):
        n = int(np.exp(rng.uniform(1.5, 5)))
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, max(1, len(s) * 15 // 100) + 1))
        t = np.unique(np.concatenate([s[drop // 2 :], rng.integers(0, 1 << 63, drop - drop // 2).astype(np.uint64)]))
        inter = len(np.intersect1d(s, t))
        if 100 * inter < 85 * (len(s) + len(t) - inter) or len(s) == inter == len(t):
            continue
        low, high = sorted((s, t), key=len)
        scheme = jaccard.band_of(len(low))
        m = segs[scheme]
        needs = []
        for x in (low, high):
            seg, _, size = jaccard._segments(x, m)
            needs.append(jaccard.need_of(seg, size, m))
        e = [jaccard.entries(x, scheme, m, jaccard.band_of(len(x)) > scheme, max(0, *needs), min(needs) < 0) for x in (low, high)]
        whole = [set((x[(x & np.uint64(1)) == 0] >> np.uint64(4)).tolist()) for x in e]
        every = [set((x >> np.uint64(4)).tolist()) for x in e]
        assert whole[0] & every[1] or whole[1] & every[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(200, 200), (300, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in [*range(41), 300]} | {i: 100 for i in range(100, 150)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_all_scores(spark, seed):
    random.seed(seed)
    centre = [[random.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [random.gauss(m, 0.2) for m in random.choice(centre)]) for i in range(1, 900)]
    rows += [(1000 + i, rows[99][1]) for i in range(30)]  # equal vectors: ties
    odd = [(5000, None), (5001, [float("nan")] * 6), (5002, [None, 1.0]), (5003, [1.0, 2.0]), (5004, []), (None, [1.0] * 6), (5100, [float("inf")] * 6), (5200, [0.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as cell", "2 as grp", "3 as score", "4 as rank")
    got = {}
    for r in voronoi.top_k(df, block=128, group=3, sample=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows + [(5003, [1.0, 2.0]), (5004, []), (5200, [0.0] * 6)]]
    for q, v in ok:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:10]
            assert sorted(got.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert not got
    assert voronoi.top_k(df.limit(0)).count() == 0


def compared(df, sql, views, tmp_path):
    df.write.parquet(str(tmp_path / "got"))
    c = duckdb.connect()
    for name, path in views.items():
        c.execute(f"create view {name} as select * from '{path}/*.parquet'")
    cols = ", ".join(df.columns)
    got = f"select {cols} from '{tmp_path}/got/*.parquet'"
    for a, b in ((got, f"select {cols} from ({sql})"), (f"select {cols} from ({sql})", got)):
        assert c.execute(f"({a}) except all ({b})").fetchall() == []
    return c.execute(got).fetchall()


ENTRIES = [
    ("adult", "domain", "adult-x.example.net", "block", "2023-03-01"), ("adult", "host", "blog.adult-x.example.net", "allow", "2023-09-01"),
    ("review", "prefix", "Tionsh.example.net./en", "block", "2023-05-01"), ("review", "prefix", "tionsh.example.net/en/3", "allow", "2023-06-01"),
    ("spam", "domain", "cheap-pills.example.com", "block", "2023-01-01"), ("spam", "domain", "cheap-pills.example.com", "remove", "2023-07-01"),
    ("spam", "domain", "cheap-pills.example.com", "block", "2023-11-15"), ("spam", "host", "[::1]", "block", "2023-01-01"),
    ("a", "host", "tie.example.org", "allow", "2023-01-01"), ("b", "host", "tie.example.org", "block", "2023-01-01"), ("c", "host", "tie.example.org", "block", "2023-01-01"),
    ("x", "host", None, "block", "2023-01-01"), ("x", "host", "tie.example.org", "block", None), ("m", "host", "same.org", "allow", "2023-01-01"), ("m", "host", "same.org", "block", "2023-01-01"),
]


def judged_by_hand(url, day, entries):
    """blocked, list_name, kind, pattern of one capture, entry by entry."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)[^/?#]*([^?#]*)", url or "")
    if not m or day is None:
        return False, None, None, None
    host, path, found = m[1].lower().rstrip("."), [x for x in m[2].split("/") if x], []
    moments = {}
    for name, kind, pattern, action, since in entries:
        if None not in (name, kind, pattern, action, since):
            h, *rest = pattern.split("/")
            at = moments.setdefault((name, kind, "/".join([h.lower().rstrip("."), *rest])), {})
            at[since] = max(action, at.get(since, ""))
    for (name, kind, pattern), at in moments.items():
        now = [at[d] for d in sorted(at) if d <= day][-1:]
        if not now or now[0] == "remove":
            continue
        fits = host == pattern if kind == "host" else (host == pattern or host.endswith("." + pattern)) and host[0] != "[" if kind == "domain" else [host, *path][: pattern.count("/") + 1] == pattern.split("/")
        if fits:
            found.append(({"prefix": 2, "host": 1, "domain": 0}[kind], len(pattern), now[0] == "block", name, kind, pattern))
    if not found:
        return False, None, None, None
    best = max(found)
    return best[2:]


def test_url_lists(spark):
    """Every capture against every entry, with captures that are shuffled anew each time they are read."""
    from pyspark.sql import functions as F

    random.seed(5)
    hosts = ["cheap-pills.example.com", "x.y.cheap-pills.example.com.", "notcheap-pills.example.com", "Tionsh.example.net", "blog.adult-x.example.net", "adult-x.example.net", "tie.example.org", "[::1]", "same.org", "z.org"]
    rows = [(i, f"{random.choice(['http', 'https'])}://{random.choice(['', 'u@'])}{random.choice(hosts)}{random.choice(['', ':80', '/'])}{random.choice(['', '/en', '/en/3', '/en/3/x', '/en/30', '//en/', '/EN', '/%65n', '/en?q=/3', '/' + 'a/' * 3000])}", f"2023-{random.randint(1, 12):02}-{random.randint(1, 28):02}") for i in range(400)]
    rows += [(1000, None, "2023-05-05"), (1001, "not a url", "2023-05-05"), (1002, "", "2023-05-05"), (1003, "http://tie.example.org", None), (None, "http://tie.example.org", "2023-02-02"), rows[0], rows[0]]
    entries = spark.createDataFrame(ENTRIES, "list_name string, kind string, pattern string, action string, since string").withColumn("since", F.col("since").cast("timestamp_ntz"))
    captures = spark.createDataFrame(rows, "page_id bigint, url string, d string").selectExpr("page_id", "url", "cast(d as timestamp_ntz) as fetch_time", "1 as kind", "2 as t", "3 as best").repartition(5, F.rand())
    out = urlfilter.verdicts(captures, entries)
    want = sorted(((i, u, *judged_by_hand(u, d, ENTRIES)) for i, u, d in rows), key=str)
    for _ in range(2):
        assert sorted(((r["page_id"], r["url"], r["blocked"], r["list_name"], r["kind"], r["pattern"]) for r in out.collect()), key=str) == want
    assert {x[4] for x in want} == {None, "host", "domain", "prefix"}
    assert urlfilter.verdicts(captures.limit(0), entries).count() == 0 and urlfilter.verdicts(captures, entries.limit(0)).where("blocked").count() == 0
    assert urlfilter.keep(captures, entries).count() == sum(not x[2] for x in want)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_query(spark, tmp_path):
    pages = [(i, f"http://{['a', 'blog.b', 'c.d'][i % 3]}.example.{['com', 'org'][i % 2]}/en/{i % 7}/{i}") for i in range(200)] + [(None, "http://a.example.com/"), (7, None), (3, "x")]
    spark.createDataFrame(pages, "page_id bigint, url string").selectExpr("*", "1 as n", "2 as does", "3 as html").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    rows = compared(urlfilter.query(spark, str(tmp_path)), urlfilter.ORACLE, {"pages": tmp_path / "pages.parquet"}, tmp_path)
    assert len(rows) == len(pages)


CHAT = [
    (1, 0, "u", "Hello  there\nsecond line\n\nnew para"), (1, 1, "a", "> hello there\n> second line\n\nI agree"), (1, 2, "u", "Bob wrote:\n> I agree\n>> second line\nno"),
    (1, 3, "u", "> unknown thing\nx"), (1, 4, "a", "> no\nyes\n> i AGREE"), (1, 5, None, None), (2, 0, "u", "> \nq"), (2, 1, "u", ""), (2, 1, "u", ""),
    (None, 1, "u", "> q"), (2, None, "u", "> q\nz"), (2, 7, "u", "> q\n a > b"), (3, 0, "u", "> later\nfirst"), (3, 1, "u", "later"), (3, 2, "a", "\n".join(f"> line {i}" for i in range(3000)) + "\n> later\nlast"),
]


def test_quotations(spark):
    df = spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as depth", "2 as h", "3 as n_quotes", "4 as thread_root", "5 as leaves")
    out = chat.threaded(df)
    rows = out.collect()
    by = {(r[0], r[1]): r[3:] for r in rows}
    assert len(rows) == len(CHAT)
    assert by[1, 0] == ("Hello  there\nsecond line\n\nnew para", 0, 0, None, 0, 0, 0)
    assert by[1, 1] == ("I agree", 1, 1, 0, 0, 1, 1)
    assert by[1, 2] == ("no", 2, 2, 1, 0, 2, 2)
    assert by[1, 4] == ("yes", 2, 2, 2, 0, 3, 3)
    assert by[1, 3] == ("x", 1, 0, None, 3, 0, 0) and by[3, 0] == ("first", 1, 0, None, 0, 0, 0)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.threaded(df.limit(0)).count() == 0


def test_mail_of_conversations(spark, tmp_path, monkeypatch):
    """The query finds the replies that its rendering made, and reads threads in order; the SQL agrees. One message has very many replies."""
    monkeypatch.setattr(chat, "SPAN", 16)
    said = lambda c, t: f"Message {t} of {c}.\nIts second line.\n\nParagraph {t * 7 + c}"
    rows = [(c, t, "user" if t % 2 else None, said(c, t)) for c in range(6) for t in range(c * 9)]
    rows += [(9, 0, "u", None), (9, 1, "u", ""), (9, 2, "u", "After nothing"), (9, 2, "u", "After nothing"), (9, 3, "u", " \n "), (9, 4, "u", "x"), (None, 1, "u", "a"), (10, None, "u", "b"), (11, 0, "u", "Same"), (11, 1, "u", "Same"), (11, 2, "u", "Same"), (11, 3, "u", "Same")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as answers", "2 as said").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = compared(chat.query(spark, str(tmp_path)), chat.ORACLE, {"conversations": tmp_path / "conversations.parquet"}, tmp_path)
    answers = lambda c, t: t - (2 if (c + t) % 3 == 0 else 1)
    for conv, turn, _, text, _, _, reply_to, *_ in got:
        if conv is not None and conv < 6:
            assert text == said(conv, turn) and reply_to == (answers(conv, turn) if answers(conv, turn) >= 0 else None)
    hub = [(1, 0, "u", "The question")] + [(1, t, "u", f"> The question\nAnswer {t}") for t in range(1, 200, 3)] + [(1, t, "u", f"> Answer {t - 1}\nand so") for t in range(2, 200, 6)]
    out = {r["turn"]: r["reply_order"] for r in chat.threaded(spark.createDataFrame(hub, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert [out[t] for t in sorted(out)] == list(range(len(hub)))


def test_partial_quotations(spark):
    first = "The first line of a long\nparagraph that was wrapped. It has a second\nsentence here, and a third. Like this!\nThe end of it."
    rows = [
        (1, 0, first),
        (1, 1, "> paragraph that was wrapped. It has a second\n> sentence here, and a third. Like this!\nTwo lines"),
        (1, 2, "> It has a second sentence here, and a third.\nOne sentence"),
        (1, 3, "> It has a second sentence\n> here, and a third. Like\n> this!\nWrapped anew"),
        (1, 4, "> Like this!\n> The end of it. But not that.\nMore than the original"),
        (1, 5, "Yes.\nNo.\nMaybe."),
        (1, 6, "No.\nMaybe.\nYes.\nYes.\nNo."),
        (1, 7, "Maybe.\nYes.\nNo.\nMaybe.\nOther"),
        (1, 8, "> Maybe.\n> Yes.\n> No.\nEach pair stands earlier, the whole in 7 only"),
        (1, 9, "> later text\n> of two lines\nNot before"),
        (1, 10, "Some later text\nof two lines\nand more"),
        (1, 11, "a line\nlater text\nof two lines\nmore"),
        (1, 12, "> later text\n> of two lines\nNow it is"),
        (2, 1, "> paragraph that was wrapped. It has a second\n> sentence here, and a third. Like this!\nAnother conversation"),
    ]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    out = chat.threaded(df)
    got = {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], r["reply_to"], r["thread_root"]) for r in out.collect()}
    want = {(c, t): (0, 0, None, t) for c, t, _ in rows}
    want |= {(1, t): (1, 1, 0, 0) for t in (1, 2, 3)} | {(1, 8): (1, 1, 7, 7), (1, 12): (1, 1, 11, 11)} | {k: (1, 0, None, k[1]) for k in ((1, 4), (1, 9), (2, 1))}
    assert got == want
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

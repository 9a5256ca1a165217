"""Operators on web pages, and the pipeline as a whole."""

import hashlib
import os
import re

import pytest

from tessellon.llm import jaccard, langid, packing, quality, registry, warc, wrappers
from tessellon.llm.common import fresh_dir

SHELL = '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad-box ad">Buy</div>{}<footer>&copy; x</footer></body></html>'


def page(body):
    return SHELL.format(body)


PAGES = [
    (1, "http://a/1", page("<article><h1>Head &amp; more</h1><p><b>One <i>two</i>.<br><p>Three\n  four</p></article>"), "Head & more\nOne two.\nThree four"),
    (2, "http://a/2", page("<article><h1>H</h1><p>A&#233;&nbsp;b</p><div class='comments'><p>Me too</p></div><aside>Side</aside><form><p>Mail</p></form><p>End</p></article>"), "H\nAé b\nEnd"),
    (3, "http://a/3", page("<article><h1>H</h1><ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><p></p></article>")[:-30], "H\nx\ny\nc1\nc2"),
    (4, "http://a/4", "", ""),
    (5, "http://a/5", None, ""),
    (6, None, page("<main><header><h1>Keep</h1><p>by someone</p></header><p>Text</p></main>"), "Keep\nText"),
    (7, "http://b/1", page("<div class=wrap><div id=sidebar><p>no no no</p></div><div id=body1><p>A long enough paragraph of the page.</p><p>And another one of them.</p></div></div>"), "A long enough paragraph of the page.\nAnd another one of them."),
    (8, "http://c/1", "just text < 3 & more", "just text < 3 & more"),
    (9, "http://c/2", "<p>unclosed <!-- not this", "unclosed"),
]


def test_main_text(spark):
    rows = [p[:3] for p in PAGES] + [PAGES[0][:3]]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as wrapper", "3 as text", "4 as share")
    got = wrappers.extract(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, _, _, text in PAGES:
        assert by[i]["text"] == text, i
        assert by[i]["n_chars"] == len(text)
    assert wrappers.extract(df.limit(0)).count() == 0


def test_a_host_with_several_layouts(spark):
    para = "<p>A paragraph of the text.</p><p>And another.</p>"
    bodies = [f"<article><h1>H</h1>{para}</article>", f"<main><h1>H</h1>{para}</main>", f"<div class=content><h1>H</h1>{para}</div>", f"<div id=story><h1>H</h1>{para}</div>", f"<div class=wrap><div class=links><p>x</p></div><div class=middle><h1>H</h1>{para}</div></div>"]
    rows = [(10 * k + i, f"http://h{host}/{k}/{i}", page(b)) for host, some in (("all", bodies), ("two", bodies[2:4])) for k, b in enumerate(some, 10 * (host == "two")) for i in range(6 - k % 5)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: "H\nA paragraph of the text.\nAnd another." for i, *_ in rows}


def test_names_late_in_a_long_class_list(spark):
    grid = "col-12 col-md-4 order-2 p-3"
    body = f'<div class="{grid} sidebar"><p>Side text</p></div><div class="{grid} mb-2 entry-content"><p>Of the text.</p><div class="{grid} userComments"><p>Me too</p></div><p>End.</p></div><div class="{grid} box"><p>{"Much more text beside it. " * 9}</p></div>'
    rows = [(i, f"http://long/{i}", page(body)) for i in range(3)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert [r["text"] for r in got] == ["Of the text.\nEnd."] * 3


def test_wrapper_is_union_free_and_matches_all_its_pages():
    pages = [f"<article><h1>t</h1>{'<p>x</p>' * n}{'<h2>s</h2><p>y</p>' * (n % 3)}{'<aside>z</aside>' * (n % 2)}</article>" for n in range(6)]
    trees = [wrappers.folded(wrappers.tokenised(p)[0]) for p in pages]
    w = wrappers._fold_all([wrappers.loaded(wrappers.dumped(t)) for t in trees])
    text = wrappers.skeleton(w)
    assert "|" not in text and "?" in text and "+" in text
    for t in trees:
        assert len(wrappers.slot_flags(w, t)) == len(list(wrappers.slots(t)))
    assert wrappers.skeleton(wrappers.loaded(wrappers.dumped(w))) == text


def test_archives_round_trip(spark):
    x, y = "x" * 200, "é" * 60
    rows = [(1, "u", x), (2, "u\n2", x), (3, None, None), (4, "u", "short"), (5, "u", "short"), (None, "u", x), (2, "u", x), (9, "v", y), (8, "v", y), (7, "v", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as payload", "2 as first_id", "3 as n")
    path = fresh_dir(spark, "t")
    warc.write(df, path)
    got = warc.read(spark, path, verify=True).collect()
    assert len(got) == len(rows)
    want = {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 1), 9: ("revisit", 8), 8: ("response", None), 7: ("response", None)}
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert (r["record_type"], r["refers_to"]) == want[r["page_id"]]
        assert r["payload_digest"] == hashlib.sha256(html[r["page_id"]]).hexdigest() and r["payload_bytes"] == len(html[r["page_id"]])
        assert r["payload"] == (html[r["page_id"]] if r["record_type"] == "response" else None)
    some = warc.read(spark, path, warc.HEADERS).where("record_type = 'revisit' and page_id >= 2 and url like 'u%'")
    assert sorted(r["page_id"] for r in some.collect()) == [2, 2]
    reader = warc.WarcReader(path, ["page_id"], False)
    from pyspark.sql.datasource import EqualTo, StringContains

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringContains(("payload",), "x")])) == [StringContains(("payload",), "x")]
    assert sum(b.num_rows for s in reader.partitions() for b in reader.read(s)) == 4
    none = fresh_dir(spark, "t")
    warc.write(df.limit(0), none)
    assert warc.read(spark, none).count() == 0


def test_members_are_gzip():
    import gzip

    data = warc.record(1, "http://a/", b"<p>", "d" * 64, 3, None)
    assert gzip.decompress(warc.member(data) + warc.member(b"next")) == data + b"next"


def pattern(x):
    """A wrapper's item as a regular expression over one letter a key."""
    own = "".join(map(pattern, x.items)) if x.key[0] == "(" else x.key
    return f"(?:{own}){'+' if x.rep else ''}" if not x.opt else f"(?:(?:{own}){'+' if x.rep else ''})?"


def test_aligned_patterns_match_both():
    """Every wrapper of two or three short sequences matches all of them, as a regular expression tells."""
    import random

    random.seed(4)
    for _ in range(500):
        seqs = ["".join(random.choice("abcd") for _ in range(random.randint(0, 7))) for _ in range(random.randint(2, 3))]
        made = lambda t: wrappers.folded(wrappers.Group("root", items=[wrappers.Group(c) for c in t]))
        all_ = wrappers._fold_all([made(t) for t in seqs])
        for t in seqs:
            assert re.fullmatch("".join(map(pattern, all_.items)), t), (seqs, wrappers.skeleton(all_))


FILL = "the same words on every page of this host, longer than any of its texts. " * 12


def plain_page(i):
    paragraphs = "".join(f"<p{' class=search' if k == 1 else ''}>Own words {i} {k} {'x' * (i % 5)}</p>" for k in range(2 + i % 4))
    return f"<html><body><div><div><a href='/'>Home</a> {FILL}</div><div>{paragraphs}<div>Please join us now</div></div><div>{FILL} end</div></div></body></html>", "\n".join(f"Own words {i} {k} {'x' * (i % 5)}".strip() for k in range(2 + i % 4))


def test_the_wrapper_tells_template_from_text(spark):
    """Pages without article elements or telling names are read right with their host's wrapper and can't be without it, however they are dealt out."""
    from pyspark.sql import functions as F

    pages = [(i, f"http://one.org/{i}", plain_page(i)[0]) for i in range(12)] + [(100 + i, f"http://{i}.org/", plain_page(i)[0]) for i in range(3)]
    pages += [(200 + i, "http://copies.org/", "<article><h1>Title</h1><p>Only copies</p></article>") for i in range(9)] + [(300, "http://one.org/again", pages[0][2])]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df.coalesce(1)).collect()}
    for i in range(12):
        assert got[i] == plain_page(i)[1]
        assert FILL.strip() in got[100 + i % 3]  # a host of one page shows no difference
    assert {got[200 + i] for i in range(9)} == {"Title\nOnly copies"} and got[300] == got[0]
    for n in (3, 7):
        assert {r["page_id"]: r["text"] for r in wrappers.extract(df.repartition(n, F.xxhash64("page_id", F.lit(n)))).collect()} == got


def test_long_and_broken_pages_take_linear_time():
    import time

    cases = {"<x " * 1_500_000: "", "<a \"'>" * 800_000: None, "<div>" * 400_000 + "t" + "</section>" * 400_000: "t", "<li><div>" + "<ul>" * 400_000 + "</li>" * 400_000: "", "<!-- <!--" * 500_000: "", "<p>" + "&amp;" * 1_000_000: "&" * 1_000_000, "< " * 2_000_000: None}
    for html, want in cases.items():
        began = time.time()
        text = wrappers.main_text(html, None, {})
        assert time.time() - began < 20 and (want is None or text == want), html[:20]
    deep = "<div>" * 3000 + "<article>good<aside>bad</aside>more<p class='a b c d e hidden'>no</p></article>"
    assert wrappers.main_text(deep, None, {}) == "good\nmore"


def test_archives_by_others(spark, tmp_path):
    """Plain files, gzip members without a length field, files compressed as a whole; all kinds of records; damage never hangs."""
    import gzip

    http = lambda body: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    rec = lambda kind, block, ctype=b"application/http;msgtype=response", more=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/" + kind + b"\r\n" + more + b"Content-Type: " + ctype + b"\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    big = b"<p>" + b"x" * 300_000 + b"\r\n\r\n</p>"
    records = [rec(b"warcinfo", b"software: y\r\n", b"application/warc-fields"), rec(b"request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", b"application/http;msgtype=request"), rec(b"response", http(big), more=b"WARC-Payload-Digest: sha1:ABC\r\n"), rec(b"resource", b"", b"text/plain"), rec(b"response", http(b"end"))]
    forms = {"plain.warc": b"".join(records), "members.warc.gz": b"".join(map(gzip.compress, records)), "whole.warc.gz": gzip.compress(b"".join(records))}
    for name, data in forms.items():
        (d := tmp_path / name.replace(".", "_")).mkdir()
        (d / name).write_bytes(data)
        rows = warc.read(spark, f"file://{d}", verify=True).collect()
        assert [r["record_type"] for r in rows] == ["warcinfo", "request", "response", "resource", "response"]
        assert [bytes(r["payload"] or b"") for r in rows][2:] == [big, b"", b"end"] and rows[2]["payload_digest"] == "sha1:ABC" and rows[0]["page_id"] is None
        assert [r["payload_bytes"] for r in warc.read(spark, f"file://{d}", warc.HEADERS).where("record_type = 'response'").collect()] == [None, None]
        for cut in (len(data) - 30, len(data) // 2, 40):
            (d / name).write_bytes(data[:cut])
            with pytest.raises(Exception, match="before byte"):
                warc.read(spark, f"file://{d}").collect()
            assert spark.read.format("warc").schema(warc.READ_SCHEMA).option("malformed", "skip").load(f"file://{d}").count() <= 5
    (d := tmp_path / "bad").mkdir()
    for data in (warc.member(b"WARC/1.1\r\nContent-Length: 3\r\n"), b"WARC/1.1\r\nContent-Length: 99\r\n\r\nx", b"no archive\r\n\r\n"):
        (d / "a.warc").write_bytes(data)
        with pytest.raises(Exception, match="before byte"):
            warc.read(spark, f"file://{d}").collect()


def test_appends_keep_each_other(spark):
    """Manifests are files of their own: what one append commits, another can't lose."""
    path = fresh_dir(spark, "t")
    df = spark.createDataFrame([(1, "http://a/", "x" * 200), (2, "http://b/", "y" * 200)], "page_id bigint, url string, html string")
    warc.write(df, path)
    first, second = warc.WarcWriter(path), warc.WarcWriter(path)
    batch = warc.deduplicated(df).toArrow().to_batches()
    told = [w.write(iter(batch)) for w in (first, second)]
    first.commit(told[:1])
    second.commit(told[1:])
    assert warc.read(spark, path).count() == 6


def test_every_operator_is_registered():
    import __spark_entry__

    names = registry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(registry.oracle_sql()) <= set(names) and {*names, "pipeline"} <= set(__spark_entry__.queries())


def test_stages_equal_their_operators(spark, tmp_path):
    import corpus_pipeline as cp

    from test_text_operators import ODD, corpus

    rows = corpus(120)
    rows += [(200 + i, t + " tail", lang, s) for i, (_, t, lang, s) in enumerate(rows[:30]) if len(t.split()) > 60]
    rows += [(500 + i, t, None, None) for i, t in enumerate(ODD)] + [(900, "qqqq xxxx zzzz jjjj vvvv kkkk " * 1 + " ".join(f"zx{'q' * (i % 9)}jk" for i in range(30)), None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = {r["doc_id"] for r in quality.verdicts(docs).where("kept").collect()}
    left = docs.where(docs.doc_id.isin(sorted(first)))
    second = {r["doc_id"] for r in langid.predict(left, langid.fit(left)).where("not rejected").collect()}
    left = docs.where(docs.doc_id.isin(sorted(second)))
    third = {r["component_id"] for r in jaccard.joined(left, words=5, percent=80).collect()}
    want = packing.packed(docs.where(docs.doc_id.isin(sorted(third)))).collect()
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted(got) == sorted(want)
    assert set(range(120)) & third and not {500, 501, 900} & third and len(third) < len(second)
    assert [f(spark, docs, str(tmp_path)).columns == docs.columns for _, f in cp.STAGES[:-1]] == [True] * 3


def test_tables_note_and_delete_what_is_spent(spark):
    from tessellon.llm.common import materialise, tables

    there = lambda df: os.path.exists(re.sub("^file:/+", "/", df.inputFiles()[0]))
    with tables(spark) as drop:
        a, b = materialise(spark.range(3), "a"), materialise(spark.range(4), "b")
        with tables(spark) as inner:
            c, d = materialise(spark.range(5), "c"), materialise(spark.range(6), "d")
            inner(c)
        assert [there(x) for x in (a, b, c, d)] == [True, True, True, False]
        drop(b)
        assert [there(x) for x in (a, b, c)] == [False, True, False] and b.count() == 4


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from tessellon.llm import common

    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

    class Far:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="machines share"):
        common.shared_dir(Far)

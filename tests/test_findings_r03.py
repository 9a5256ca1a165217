"""Cases that the findings of round 3 name."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tessellon import plans
from tessellon.functions import sketch

SF = "/root/testdata/sf0.001"


def broadcast_nodes(df):
    """The names of the plan's nodes below any broadcast."""
    found, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            found.append(line.strip(" :+-").lstrip("*()0123456789 "))
        else:
            depth = at if "BroadcastExchange" in line else None
    return found


def against_sql(spark, name, sf_dir, **tables):
    """Rows of a query, and of its SQL over tables by path."""
    c = duckdb.connect()
    for t, path in tables.items():
        c.sql(f"create view {t} as select * from '{path}'")
    got = plans.queries()[name](spark, sf_dir)
    want = c.execute(f"select {', '.join(got.columns)} from ({plans.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_rolling_quantile_is_exact_and_broadcasts_nothing_spread(spark):
    start = datetime(2026, 1, 1)
    rows = [(start + timedelta(minutes=m), float(v)) for m, v in [(0, 5), (0, 5), (1, 1), (1, 7.0), (1, 7.01), (2, 0), (2, 900), (9, 3), (9, 3.001), (9, 2.999)] for _ in range(1 + m)]
    e = spark.createDataFrame(rows, "pane timestamp, s double")
    counted = e.groupBy("pane", "s").agg(F.count("*").alias("n")).withColumn("bucket", sketch.bucket(F.col("s")))
    for q in (0.0, 0.3, 0.5, 0.95, 1.0):
        found = sketch.located(sketch.rolling(sketch.merged(counted, ["pane"]), "pane", 5, "1 minute"), ["window_end"], q)
        got = {r["window_end"]: (r["n"], r["exact"]) for r in sketch.exact_rolling(found, counted, "pane", "s", 5, "1 minute", "exact").collect()}
        spans = {end: sorted(v for t, v in rows if end - timedelta(minutes=5) <= t < end) for end in {t + timedelta(minutes=1) for t, _ in rows}}
        assert got.keys() == spans.keys()
        for end, vs in spans.items():
            at = (len(vs) - 1) * q
            lo, hi = vs[int(at)], vs[-int(-at // 1)]
            assert got[end][0] == len(vs) and got[end][1] == pytest.approx(lo + (hi - lo) * (at - int(at)), abs=1e-12)
    assert not [n for n in broadcast_nodes(plans.queries()["dq_lateness_rolling"](spark, SF)) if n.startswith("Generate")]


@pytest.mark.parametrize("name", ["payload_to_gold", "lifecycle_corrections"])
def test_events_with_ids_of_seven_digits_stay_apart(spark, tmp_path, name):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("k", F.explode(F.array(F.lit(0), F.lit(10_000_000)))).withColumn("event_id", F.col("event_id") + F.col("k")).drop("k")
    e.write.parquet(str(tmp_path / "events.parquet"))
    got, want = against_sql(spark, name, str(tmp_path), events=f"{tmp_path}/events.parquet/*.parquet")
    assert got == want


def test_shards_of_the_lexical_index_are_read_and_written_a_few_at_a_time(spark):
    import pyarrow.parquet as pq

    from tessellon.llm import lexical

    words = F.transform(F.sequence(F.lit(0), F.lit(150_000)), lambda i: F.hex(F.xxhash64(i, "doc_id")))
    docs = spark.range(16).coalesce(1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    shards, n = lexical.index(docs)
    assert n == 16
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in map(lambda f: f.replace("file://", "file:"), shards.inputFiles())]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert len(sizes) > 2 and max(sizes) < 40 << 20


def test_pairs_of_small_and_large_groups_need_no_join_of_small_ones(spark):
    from itertools import combinations

    from tessellon.operators import mining

    rows = [(g, i, (g * i) % 3 + 10 * x) for g in range(6) for i in range(0, 4 + 7 * (g % 2), 1 + g // 3) for x in (0, 1)] + [(None, 1, 0), (None, 2, 0), (7, None, 0)]
    table = spark.createDataFrame(rows, "g int, i int, c int")
    for counted in ("g", "c"):
        want = {}
        for g, ps in {g: {(i, g if counted == "g" else c) for h, i, c in rows if h == g and i is not None} for g, *_ in rows if g is not None}.items():
            for p, q in combinations(sorted(ps), 2):
                if p[0] != q[0]:
                    want.setdefault((p[0], q[0]), set()).add(p[1])
        want = sorted((a, b, len(v)) for (a, b), v in want.items() if len(v) >= 2)
        for block in (1, 3, 1024):
            assert sorted(map(tuple, mining.copairs(table, "i", ["g"], counted, block=block).collect())) == want, (counted, block)
    plan = mining.copairs(table, "i", ["g"], "g")._jdf.queryExecution().optimizedPlan().toString()
    last = [x.strip(" :+-") for x in plan.splitlines() if "Aggregate [a#" in x]
    assert len(last) == 1  # one count of the pairs, no distinct triples before it


def test_rules_count_their_pairs_once(spark):
    from tessellon.operators import mining

    rules = mining.pair_rules(spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)], "o int, p int"), "o", "p")
    assert sorted((r["a"], r["b"], r["n"], round(r["confidence"], 3)) for r in rules.collect()) == [(1, 2, 2, 0.667), (2, 1, 2, 1.0)]
    plan = rules._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [a#" in x and "o#" in x.split("], [")[0]]  # no distinct triples


def test_layer_keys_are_counted_without_a_join(spark):
    from tessellon.operators import reconcile

    table = lambda keys: spark.createDataFrame([("t", k) for k in keys], "x string, k int")
    b, s, q = [1, 2, 2, 3, 4, None], [1, 1, 2, 9, None], [2, 2, 3, None]
    got = reconcile.layer_keys(table(b), table(s), table(q), ["x", "k"])
    # as two left joins give it: 1 twice, each 2 twice, 3, 4 and the null once
    assert tuple(got.first()) == (6, 5, 4, 2)
    assert tuple(reconcile.layer_keys(*[table([])] * 3, ["x", "k"]).first()) == (0, 0, 0, 0)
    got, want = against_sql(spark, "layer_keys", SF, events=f"{SF}/events.parquet")
    assert got == want
    assert "Join" not in plans.queries()["layer_keys"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_pass_of_kmeans_runs_in_arrow_batches(spark):
    import numpy as np

    from tessellon.operators import mining

    x = np.random.default_rng(1).normal(size=(300, 5))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    for c, (cost, moved) in zip(sets := [x[:3], x[10:12]], mining._lloyd(rows, sets)):
        gap = ((x[:, None] - c[None]) ** 2).sum(2)
        assert cost == pytest.approx(gap.min(1).sum())
        assert np.allclose(moved, [x[gap.argmin(1) == k].mean(0) for k in range(len(c))])
    seen = []
    real, type(rows).mapInArrow = type(rows).mapInArrow, lambda self, *a, **b: seen.append(a) or real(self, *a, **b)
    try:
        mining._lloyd(rows, sets)
    finally:
        type(rows).mapInArrow = real
    assert seen


def test_tasks_of_pairs_are_counted_by_rows_and_pairs(spark, tmp_path, monkeypatch):
    from tessellon.operators import mining

    rows = [(o, (o * (k + 3)) % 17) for o in range(100) for k in range(4)] + [(None, 1), (None, 2), (7, None), (1000, None), (None, None)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    for n_rows, n_pairs, tasks in ((50, 10_000, 9), (10_000, 50, 13)):
        monkeypatch.setattr(mining, "PAIR_ROWS", n_rows, raising=False)
        monkeypatch.setattr(mining, "PAIRS", n_pairs, raising=False)
        for name in ("copairs", "association"):
            got, want = against_sql(spark, name, str(tmp_path), lineitem=f"{tmp_path}/lineitem.parquet/*.parquet")
            assert got == want and got
            plan = plans.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            for keys in ("l_partkey#", "_slice#", "a#"):
                assert [x for x in plan.splitlines() if f"hashpartitioning({keys}" in x and f", {tasks}), REPARTITION_BY_NUM" in x], (name, keys)


def test_weights_of_many_parts_shuffle_no_counts(spark, tmp_path):
    from tessellon.operators import mining

    words = "alpha beta Gamma delta ümlaut x_1 42 the the zeta".split()
    rows = [(i % 90, " ".join(words[(i * k) % 10] for k in range(1, 2 + i % 7)) + f" own{i} o{i // 2}") for i in range(120)] + [(200, None), (201, ""), (202, "a . b"), (203, "lone"), (204, "the the")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole, want = against_sql(spark, "tfidf", str(tmp_path), documents=f"{tmp_path}/documents.parquet/*.parquet")
    assert whole == want
    for chars in (1 << 22, 1000, 40):
        got = mining.tfidf(docs, part_chars=chars)
        assert sorted((r["doc"], r["term"], round(r["weight"], 5)) for r in got.collect()) == [(d, t, pytest.approx(w, abs=2e-5)) for d, t, w in want]
    labels = [mining._labels(spark, n) for n in (1, 7, 300)]
    assert [len(set(x)) for x in labels] == [1, 7, 300]
    assert spark.createDataFrame([(i,) for i in labels[1]], "i int").repartition(7, "i").select(F.spark_partition_id()).distinct().count() == 7
    # a document without an id keeps its terms, and counts for those of others
    got = {(r["doc"], r["term"]): r["weight"] for r in mining.tfidf(spark.createDataFrame([(None, "one two"), (1, "two six"), (2, "two")], "doc_id int, text string"), part_chars=3).collect()}
    assert got.keys() == {(None, "one"), (None, "two"), (1, "two"), (1, "six"), (2, "two")} and got[None, "two"] == got[1, "two"] < got[1, "six"]
    plan = mining.tfidf(docs, part_chars=40)._jdf.queryExecution().executedPlan().toString()
    by = [x.split("hashpartitioning(")[1].split("#")[0] for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert sorted(by) == ["part", "part", "term"]

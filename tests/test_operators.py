import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text, vectors
from lodestone.operators import ann, chunk, graph, hierarchy, incremental, lexical, rank
from lodestone.plans import planner


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, path string, text string, symbols array<string>")


def scores(spark, rows, query, boosted=True):
    d = docs(spark, *rows)
    fields = lexical.boosted_fields(F.col("text"), F.col("path"), F.col("symbols")) if boosted else lexical.plain_field(F.col("text"))
    found = lexical.score(d, fields, lexical.query_terms(spark, query, boosted))
    return {r["id"]: r["bm25"] for r in found.collect()}


def test_rarer_term_outscores_and_unknown_is_zero(spark):
    s = scores(spark, [("a", "a", "common rare", None), ("b", "b", "common word", None), ("c", "c", "common", None)], "rare", False)
    assert s["a"] > 0 and s["b"] == s["c"] == 0
    assert set(scores(spark, [("a", "a", "x", None)], "nothing").values()) == {0.0}


def test_file_name_and_symbol_beat_content(spark):
    s = scores(spark, [("a", "src/parser.rs", "alpha beta", None), ("b", "src/other.rs", "parser beta", None), ("c", "src/third.rs", "alpha gamma", ["parser"])], "parser")
    assert s["a"] > s["b"] and s["c"] > s["b"]


def test_saturation(spark):
    s = scores(spark, [("a", "a", "term " * 3, None), ("b", "b", "term " * 100, None), ("c", "c", "other", None)], "term", False)
    assert s["b"] < 10 * s["a"]


def test_postings_give_the_same_scores(spark):
    d = docs(spark, ("a", "x/a.rs", "one two two", None), ("b", "b.rs", "two three", None), ("c", "c.rs", "", None))
    f = lexical.boosted_fields(F.col("text"), F.col("path"))
    terms = Counter({"two": 2, "a": 1, "b": 1})
    left = {r["id"]: r["bm25"] for r in lexical.score(d, f, terms).collect() if r["bm25"] > 0}
    right = {r["id"]: r["bm25"] for r in lexical.score_postings(lexical.postings(d, "id", f), lexical.corpus_stats(lexical.lengths(d, "id", f)), "id", terms).collect()}
    assert left == pytest.approx(right) and left


def test_empty_corpus(spark):
    assert scores(spark, [("a", "a", "x", None)], "") == {"a": 0.0}
    d = docs(spark, ("a", "a", "x", None)).limit(0)
    assert lexical.score(d, lexical.plain_field(F.col("text")), Counter({"x": 1})).count() == 0


@pytest.mark.parametrize("values, want", [([3.0], [0.5]), ([2.0, 2.0], [0.5, 0.5]), ([0.0, 5.0, 10.0], [0.0, 0.5, 1.0]), ([-2.0, 0.0], [0.0, 1.0])])
def test_normalise(spark, values, want):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, bm25 double")
    assert [r["bm25_norm"] for r in rank.normalise(d).orderBy("i").collect()] == want


def results(spark, rows):
    return spark.createDataFrame(rows, "id string, path string, start_line int, hash string, score double, vector array<double>")


def test_suppression_keeps_the_best(spark):
    rows = [("1", "a", 1, "h", 0.7, [1.0, 0.0]), ("2", "b", 1, "h", 0.9, [0.0, 1.0]), ("3", "c", 1, "i", 0.8, [0.01, 1.0]), ("4", "d", 1, "j", 0.6, [-1.0, 0.0])]
    assert {r["id"] for r in rank.suppress_near_duplicates(results(spark, rows)).collect()} == {"2", "4"}
    assert {r["id"] for r in rank.suppress_near_duplicates(results(spark, rows), 1.0).collect()} == {"2", "3", "4"}


def test_feedback_takes_five_and_then_asks_for_two(spark):
    best = spark.createDataFrame([("bb aaa aaa ccc ccc ddd eee fff query query",)], "text string")
    assert [r["term"] for r in rank.feedback_terms(best, "query").collect()] == ["aaa", "ccc"]


def test_max_merge(spark):
    a = spark.createDataFrame([("1", 0.5), ("2", 0.5)], "id string, score double")
    b = spark.createDataFrame([("1", 0.6), ("3", 0.1)], "id string, score double")
    assert {tuple(r) for r in rank.max_merge(a, b).select("id", "score").collect()} == {("1", 0.6), ("2", 0.5), ("3", 0.1)}


@pytest.mark.parametrize("n, filters, want", [(499, [], "linear"), (500, [], "ann"), (999, [], "ann"), (1000, [], "binary"), (5000, ["lang=c"], "linear")])
def test_strategy(n, filters, want):
    assert planner.choose(n, planner.SearchOptions(filters=filters)) == want


def test_line_windows(spark):
    text = "\n".join(f"l{i}" for i in range(450))
    files = spark.createDataFrame([("a", text), ("b", ""), ("c", "x\n")], "path string, text string")
    got = {(r["path"], r["start_line"], r["end_line"]) for r in chunk.line_windows(files).collect()}
    assert got == {("a", 1, 400), ("a", 401, 450), ("b", 1, 0), ("c", 1, 1)}
    built = {r["path"]: r["text"] for r in chunk.build(chunk.line_windows(files).where("path = 'c'")).collect()}
    assert built == {"c": "// File: c\nx"}


def test_rollups(spark):
    rows = [("d/a", [2.0, 0.0]), ("d/a", [0.0, 2.0]), ("d/b", [0.0, 1.0]), ("root", [1.0, 0.0])]
    files = hierarchy.files(spark.createDataFrame(rows, "path string, vector array<double>"))
    found = {r["path"]: r for r in files.collect()}
    assert found["d/a"]["vector"] == pytest.approx([2**-0.5, 2**-0.5]) and found["d/a"]["chunk_count"] == 2
    dirs = {r["path"]: (r["file_count"], r["chunk_count"]) for r in hierarchy.directories(files).collect()}
    assert dirs == {"d": (2, 3), "": (1, 1)}


def small_graph(spark):
    symbols = spark.createDataFrame([("1", "Alpha", "function", "a.rs", 1, 3), ("2", "alphabet", "class", "a.rs", 5, 9), ("3", "Beta", "function", "b.rs", 1, 2)], "id string, name string, kind string, file_path string, start_line int, end_line int")
    edges = spark.createDataFrame([("1", "3", "calls", None), ("1", "3", "calls", None), ("2", "3", "implements", None), ("1", "9", "calls", None), ("3", None, "calls", "x.Alpha")], "source_id string, target_id string, kind string, metadata string")
    imports = spark.createDataFrame([("b.rs", "a"), ("c.rs", "lib/a.rs")], "source_file string, target_path string")
    return graph.Graph(symbols, edges, imports)


def test_graph_queries(spark):
    g = small_graph(spark)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(g.by_prefix("ALPHA")) == ["1", "2"] and ids(g.by_name("Alpha")) == ["1"]
    assert ids(g.callers("3")) == ["1", "1"] and ids(g.callees("1")) == ["3", "3"] and ids(g.implementors("3")) == ["2"]
    assert ids(g.definitions("Alpha", "class")) == [] and ids(g.in_file("a.rs")) == ["1", "2"]
    assert sorted(r[0] for r in g.importers("a.rs").collect()) == ["b.rs", "c.rs"]
    assert {r["metric"]: r["value"] for r in g.stats().collect()}["kind:function"] == 2
    left = g.remove_files(spark.createDataFrame([("a.rs",)], "path string"))
    assert ids(left.symbols) == ["3"] and left.edges.count() == 1
    assert ids(g.resolve_calls().callers("1")) == ["3"]


def test_delete_paths(spark):
    rows = spark.createDataFrame([("src/a/x",), ("src/ab",), ("src/a",), ("z",)], "path string")
    gone = spark.createDataFrame([("src/a",)], "path string")
    assert sorted(r[0] for r in incremental.delete_paths(rows, gone).collect()) == ["src/ab", "z"]


def test_events(spark):
    t = datetime(2024, 1, 1)
    rows = [("create", ["a"], t), ("rename", ["a", "b"], t + timedelta(milliseconds=400)), ("access", ["c"], t), ("remove", ["d"], t + timedelta(seconds=5))]
    cats = incremental.categorise(spark.createDataFrame(rows, "kind string, paths array<string>, ts timestamp"))
    assert {(r["path"], r["op"]) for r in cats.collect()} == {("a", "touched"), ("a", "deleted"), ("b", "touched"), ("d", "deleted")}
    found = incremental.sessions(cats).orderBy("started").collect()
    assert [(r["touched"], r["deleted"]) for r in found] == [(["a", "b"], ["a"]), ([], ["d"])]
    assert {(r["path"], r["op"]) for r in incremental.last_event(cats).collect()} == {("a", "deleted"), ("b", "touched"), ("d", "deleted")}


def test_cache(spark):
    chunks = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("b", "h1")], "path string, hash string")
    cache = spark.createDataFrame([("h1", [1.0]), ("h1", [1.0])], "hash string, vector array<double>")
    joined = incremental.cache_join(chunks, cache)
    assert joined.count() == 3 and tuple(incremental.hit_ratio(joined).first())[:2] == (3, 2)
    assert {(r["path"], r["complete"]) for r in incremental.completed_files(joined).collect()} == {("a", False), ("b", True)}


def test_tokens_are_counted_and_chosen_as_they_are_made(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choice("ab_9 \u00e9\u00df\u4e2d\U0001f600.-\u0130K\n") for _ in range(rng.randrange(60))),) for _ in range(300)]
    d = spark.createDataFrame([*rows, ("",)], "t string")
    want = text.tokenize(F.col("t"))
    got = d.select(want.alias("all"), text.token_count(F.col("t")).alias("n"), text.tokens_like(F.col("t"), ["a", "_b", "\u00e9"]).alias("some")).collect()
    assert all(r["n"] == len(r["all"]) and r["some"] == [w for w in r["all"] if w.startswith(("a", "_b", "\u00e9"))] for r in got)
    assert sum(len(r["some"]) for r in got) > 50


def test_neighbour_index_holds_every_row_and_finds_most(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.4 * rng.normal(size=16)]) for i in range(1500)] + [(2000, None), (2001, [0.0] * 16)]
    d = spark.createDataFrame(rows, "chunk_idx long, vector array<double>")
    cells = ann.Cells.fit(d, cells=24, probes=6, sample=600)
    indexed = cells.assign(d).persist()
    assert indexed.count() == 1502 and indexed.where("cell is null").select("chunk_idx").collect() == [(2000,)]
    assert ann.recall(indexed.where("vector is not null"), cells, [v for i, v in rows[:1500] if i % 100 == 0]) >= 0.9
    cells.save(spark, str(tmp_path / "cells"))
    again = ann.Cells.load(spark, str(tmp_path / "cells"))
    assert np.allclose(again.centres, cells.centres) and again.probes == 6
    empty = ann.Cells.fit(d.limit(0))
    assert empty.assign(d.limit(0)).count() == 0 and d.limit(0).withColumn("cell", F.lit(1)).where(empty.near([1.0])).count() == 0
    indexed.unpersist()


def test_many_queries_at_once_equal_one_by_one(spark):
    rng = np.random.default_rng(8)
    some = [[float(x) for x in v] for v in rng.normal(size=(150, 8))]
    odd = [[0.0] * 8, [1e-170] * 8, [1e200] * 8, [float("inf"), *[1.0] * 7], [float("nan"), *[1.0] * 7]]
    # copies under other keys, ties after rounding, negative keys
    rows = [*some, *some[:30], *[some[0]] * 25, *[[x + 1e-8 for x in some[1]]] * 6, *odd]
    d = spark.createDataFrame([(700 - 3 * i, v) for i, v in enumerate(rows)], "chunk_idx long, vector array<double>").repartition(3)
    cells = ann.Cells.fit(d.where("chunk_idx > 100"), cells=9, probes=2)
    held = cells.assign(d).persist()
    asked = [*some[:12], *odd, [-x for x in some[1]]]
    got = ann.nearest(held, cells, asked, 7).collect()
    for i, q in enumerate(asked):
        for probed, of in ((False, held), (True, held.where(cells.near(q)))):
            want = [(round(r["semantic"] * 1e6), r["chunk_idx"]) for r in ann.exact(of, vectors.literal(q), 7).select(F.round("semantic", 6).alias("semantic"), "chunk_idx").collect()]
            assert sorted(((r["units"], r["key"]) for r in got if r["query"] == i and r["probed"] == probed), key=lambda x: (-x[0], x[1])) == want, (i, probed)
    held.unpersist()


def test_recall_takes_no_more_jobs_for_more_queries(spark):
    rng = np.random.default_rng(9)
    some = [[float(x) for x in v] for v in rng.normal(size=(400, 6))]
    d = spark.createDataFrame(list(enumerate(some)), "chunk_idx long, vector array<double>")
    cells = ann.Cells.fit(d, cells=10, probes=4)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (5, 60):
        spark.sparkContext.setJobGroup(f"recall-{n}", "")
        share = ann.recall(cells.assign(d), cells, some[:n])
        spark.sparkContext._jsc.clearJobGroup()
        jobs.append(len(tracker.getJobIdsForGroup(f"recall-{n}")))
    assert 0 < jobs[0] == jobs[1]
    alone = [{r[0] for r in ann.exact(x, vectors.literal(some[i]), 10).select("chunk_idx").collect()} for i in range(8) for h in [cells.assign(d)] for x in (h, h.where(cells.near(some[i])))]
    assert ann.recall(cells.assign(d), cells, some[:8]) == sum(len(a & b) for a, b in zip(alone[::2], alone[1::2], strict=True)) / 80
    # queries without a vector, or of another length than any row's, find nothing
    assert ann.recall(cells.assign(d), cells, [None, [], [1.0, None]]) == 1.0 and 0 < share < 1


def test_a_search_leaves_nothing_cached(spark):
    d = spark.createDataFrame([(i, str(i), f"p{i}.rs", "rust", 1, f"alpha beta w{i}", f"h{i}", [float(i % 7), 1.0, -1.0]) for i in range(60)], "chunk_idx long, id string, path string, language string, start_line int, text string, hash string, vector array<double>")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    want = None
    for strategy in ("linear", "ann", "binary"):
        found = planner.search(d, "alpha w3", lambda q: [3.0, 1.0, -1.0], planner.SearchOptions(limit=5, strategy=strategy, dedup=False)).collect()
        assert len(found) == 5 and spark.sparkContext._jsc.getPersistentRDDs().size() == held
        want = want or {r["id"] for r in found[:1]}
        assert want <= {r["id"] for r in found}


@pytest.mark.parametrize("gap", ["500 milliseconds", "3 seconds"])
def test_bursts_of_a_table_equal_a_plain_walk(spark, gap):
    import datetime

    rng = random.Random(3)
    base, at, rows = datetime.datetime(2024, 5, 1), 0.0, []
    for _ in range(400):
        at += rng.choice([0.0, 0.1, 0.5, 0.5, 0.6, 2.9, 3.0, 3.1, 40.0])
        rows.append((base + datetime.timedelta(seconds=at), f"p{rng.randrange(9)}", rng.choice(["touched", "deleted"])))
    limit = datetime.timedelta(milliseconds=500) if "milli" in gap else datetime.timedelta(seconds=3)
    want = []
    for ts, path, op in rows:
        if not want or ts - want[-1][1] > limit:
            want.append([ts, ts, 0, set(), set()])
        want[-1][1] = ts
        want[-1][2] += 1
        want[-1][3 if op == "touched" else 4].add(path)
    got = incremental.sessions(spark.createDataFrame(rows, "ts timestamp_ntz, path string, op string"), gap=gap).orderBy("started").collect()
    assert [(r["started"], r["ends"], r["n_events"], r["touched"], r["deleted"]) for r in got] == [(a, b + limit, n, sorted(t), sorted(d)) for a, b, n, t, d in want]


def test_graph_takes_more_rows(spark):
    from lodestone import schemas

    symbol = lambda i, name: (i, name, name, "function", "a.py", 1, 2, "python", "def", None, None)
    g = graph.Graph(*(spark.createDataFrame(rows, s) for rows, s in (([symbol("1", "f")], schemas.SYMBOLS), ([], schemas.EDGES), ([], schemas.IMPORTS))))
    g = g.add_symbols(spark.createDataFrame([symbol("1", "renamed"), symbol("2", "g")], schemas.SYMBOLS))
    g = g.add_edges(spark.createDataFrame([("1", "2", "calls", None)], schemas.EDGES)).add_imports(spark.createDataFrame([("a.py", "os", None, 1, False)], schemas.IMPORTS))
    assert g.symbol("1").first()["name"] == "renamed" and g.symbols.count() == 2
    assert [r["id"] for r in g.callees("1").collect()] == ["2"] and g.imports_of("a.py").count() == 1

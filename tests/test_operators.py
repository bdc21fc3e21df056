import random

import pytest
from pyspark.sql import functions as F

from quernel.functions import exprs
from quernel.operators import clones, derived, evidence, graph, history, index, notes, search
from quernel.streaming import feeds

EDGE = "src bigint, dst bigint, kind string, confidence string"


def brute_components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components_on_paths_stars_and_random_graphs(spark):
    rng = random.Random(1)
    cases = [[(k, k + 1) for k in range(40)], [(50, k) for k in range(1, 50)], [(rng.randint(1, 80), rng.randint(1, 80)) for _ in range(50)], [(3, 3)], []]
    for pairs in cases:
        got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame([*pairs, (None, 4)], "src bigint, dst bigint")).collect()}
        assert got == brute_components([p for p in pairs if p[0] != p[1]])


def test_registered_ranks_are_converged_on_long_chains(spark, monkeypatch):
    chain = [(k, k + 1, "calls_name", "Exact") for k in range(24)]
    table = spark.createDataFrame(chain, "src int, dst int, kind string, confidence string")
    monkeypatch.setattr(graph, "edges", lambda s, d: table)
    monkeypatch.setattr(derived, "edges", lambda s, d: table)
    monkeypatch.setattr(derived, "table", lambda s, d, name: s.createDataFrame([(24, 1)], "s_suppkey int, s_nationkey int"))
    rank = [1.0]
    for _ in range(24):
        rank.append(1 + 0.85 * rank[-1])
    want = {k: x / sum(rank) for k, x in enumerate(rank)}
    got = {r.node: r["rank"] for r in graph.q_pagerank(spark, "").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 3e-6 for k in want)
    place = {r.node: r.place for r in derived._gap(spark, "").collect()}
    assert [place[k] for k in (23, 20, 10, 0)] == [2, 5, 15, 25] and 24 not in place


def test_pagerank_conserves_mass_and_personalises(spark):
    rows = [(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 2.0), (5, 4, 1.0)]
    links = spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    ranks = {r.node: r["rank"] for r in graph.pagerank(links).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9
    n = {k: 1 / 5 for k in range(1, 6)}
    for _ in range(200):
        out = {}
        for s, d, w in rows:
            out.setdefault(s, []).append((d, w))
        lost = sum(n[k] for k in n if k not in out)
        fresh = {k: 0.15 / 5 + 0.85 * lost / 5 for k in n}
        for s, ends in out.items():
            for d, w in ends:
                fresh[d] += 0.85 * n[s] * w / sum(x for _, x in ends)
        n = fresh
    assert all(abs(ranks[k] - n[k]) < 1e-5 for k in n)
    own = spark.createDataFrame([(5, 1.0)], "node bigint, weight double")
    assert {r.node: r["rank"] for r in graph.pagerank(links, personal=own).collect()}[5] > ranks[5]
    bad = spark.createDataFrame([(5, -1.0), (1, float("nan"))], "node bigint, weight double")
    got = {r.node: r["rank"] for r in graph.pagerank(links, personal=bad).collect()}
    assert all(abs(got[k] - ranks[k]) < 1e-6 for k in got)
    assert graph.pagerank(links.limit(0)).count() == 0


def test_verdicts_change_edges(spark):
    rows = spark.createDataFrame([(1, 1, 2, "calls_name", "NameOnly"), (2, 1, 3, "imports", "Exact"), (3, 1, 4, "odd", "odd"), (4, 2, None, "imports", "Exact")], "edge_id bigint, src bigint, dst bigint, kind string, confidence string")
    said = spark.createDataFrame([(1, "confirm", None), (2, "drop", None), (4, "retarget", 9)], "edge_id bigint, effect string, target bigint")
    assert {(r.src, r.dst, round(r.weight, 3)) for r in graph.ranked_edges(rows, said).collect()} == {(1, 2, 1.2), (1, 4, 1.0), (2, 9, 0.36)}


def test_coupling_gates(spark):
    commits = spark.createDataFrame([(k, 1, k * 10, "s") for k in range(1, 8)], "hash bigint, author bigint, authored_at_s bigint, subject string")
    rows = [(k, p, 1, 0) for k, paths in {1: "ab", 2: "ab", 3: "ab", 4: "cd", 5: "ac", 6: "x"}.items() for p in paths] + [(7, f"m{k}", 1, 0) for k in range(41)]
    changes = spark.createDataFrame(rows, "hash bigint, path string, additions bigint, deletions bigint")
    got = {(r.path_a, r.path_b): (r.co_change_count, r.n_commits) for r in history.change_couplings(changes, commits, least_lift=1.0).collect()}
    assert got == {("a", "b"): (3, 5)}
    assert history.change_couplings(changes, commits, window=2, least_lift=1.0).count() == 0
    assert history.churn(changes.limit(0), commits).count() == 0


def test_exprs(spark):
    df = spark.createDataFrame([("ÉTÉ Foo-bar_1,x",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(exprs.terms("t")).collect()] == [["ÉtÉ".replace("t", "t"), "foo-bar_1", "x"], None, []]
    assert exprs.query_terms("Foo foo, B") == ["foo", "b"]
    assert spark.range(1).select(exprs.round4(F.lit(0.00005))).first()[0] == 0.0001


def test_bm25_hand_case_and_empty_queries(spark):
    import math

    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "c"), (4, None), (5, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in search.bm25(docs, "A").collect()}
    idf, avg = math.log((5 - 2 + 0.5) / (2 + 0.5) + 1), 6 / 5
    want = {1: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg)), 2: idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))}
    assert got == pytest.approx(want, abs=1e-4)
    assert search.bm25(docs, " ,. ").count() == 0 and search.bm25(docs.limit(0), "a").count() == 0
    assert {r.doc_id: r.snippet for r in search.snippets(spark.createDataFrame([(1, "x\ny\nhit\nz\nw")], docs.schema), "HIT").collect()} == {1: "y\nhit\nz"}


def test_codec_round_trip_and_embeddings(spark):
    df = spark.createDataFrame([([1.0, -0.5, 0.25],), ([0.0, 0.0, 0.0],)], "v array<double>")
    back = [r[0] for r in df.select(search.decode_vector(search.encode_vector("v"))).collect()]
    assert back[0] == pytest.approx([1.0, -0.5, 0.25], abs=1 / 127) and back[1] == [0, 0, 0]
    docs = spark.createDataFrame([(1, "parseConfig file"), (2, "parse config file"), (3, ""), (4, None)], "doc_id bigint, text string")
    e = {r.doc_id: r.embedding for r in search.hash_embeddings(docs, 64).collect()}
    assert e[1] == e[2] and sum(x * x for x in e[1]) == pytest.approx(1, abs=1e-5) and not any(e[3]) and not any(e[4])


def test_clone_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(30)] for _ in range(12)]
    texts = []
    for k in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(30)] = f"w{rng.randint(0, 60)}"
        texts.append((k, rng.choice(["x", "y", None]), " ".join(t)))
    prints = clones.fingerprints(spark.createDataFrame([*texts, (99, "x", None), (98, "x", "short")], "id bigint, language string, text string"))
    got = {(r.id_a, r.id_b) for r in clones.clone_pairs(clones.bags(prints)).collect()}
    from collections import Counter

    reps = {}
    for k, lang, t in texts:
        reps.setdefault((lang or "", t), k)
    items = [(k, lang, Counter(t.split())) for (lang, t), k in reps.items()]
    want = {(min(a, b), max(a, b)) for a, la, x in items for b, lb, y in items if a < b and la == lb and (x & y).total() >= 0.7 * 30 - 1e-9}
    assert got == want
    for bad in (0.4, 1.1, float("nan")):
        with pytest.raises(ValueError):
            clones.clone_pairs(clones.bags(prints), bad)


def test_lcs_fidelity(spark):
    prints = clones.fingerprints(spark.createDataFrame([(1, "x", "a b c d"), (2, "x", "a c d e"), (3, "x", "q")], "id bigint, language string, text string"), 1)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a bigint, id_b bigint")
    assert {(r.id_a, r.id_b): r.fidelity for r in clones.lcs_ratio(pairs, prints).collect()} == {(1, 2): 0.75, (1, 3): 0.0}


def test_scope_shadows_and_tombstones(spark):
    rows = [(1, "r", "a", "source", "c", ""), (2, "r", "b", "source", "c", None), (3, "r", "c", "source", "c", ""), (4, "r", "b", "deleted", "", "w"), (5, "r", "c", "source", "", "w"), (6, "q", "b", "source", "c", "")]
    files = spark.createDataFrame(rows, "id bigint, repo_id string, path string, kind string, commit_sha string, worktree_id string")
    assert {r.id for r in index.scoped_files(files).collect()} == {1, 5, 6}


def test_line_and_heading_chunks(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\n"), (2, ""), (3, None), (4, "x\n# H\ny\n## I")], "doc_id bigint, text string")
    got = [(r.doc_id, r.chunk, r.start_line, r.end_line, r.text) for r in index.line_chunks(docs.where("doc_id < 4"), 2).orderBy("doc_id", "chunk").collect()]
    assert got == [(1, 0, 1, 2, "a\nb"), (1, 1, 3, 3, "c"), (2, 0, 1, 1, "")]
    assert {(r.section, r.heading, r.n_lines) for r in index.heading_chunks(docs.where("doc_id = 4")).collect()} == {(0, "", 1), (1, "# H", 2), (2, "## I", 1)}


def test_discovery_digest_and_consolidate(spark):
    f = "repo_id string, path string, sha256 string, language string, kind string"
    old, new = spark.createDataFrame([("r", "a", "1", None, "s"), ("r", "b", "1", "x", "s"), ("r", "c", "1", "x", "s")], f), spark.createDataFrame([("r", "a", "1", None, "s"), ("r", "b", "2", "x", "s"), ("r", "d", "1", "x", "s")], f)
    assert {r.path: r.action for r in index.discovery_plan(old, new).collect()} == {"a": "keep", "b": "change", "c": "delete", "d": "add"}
    assert index.content_digest(old).collect() == index.content_digest(old.orderBy(F.desc("path"))).collect()
    both = index.consolidate({"one": old.drop("kind"), "two": new})
    assert both.count() == 6 and both.where("repo_id = 'one' and kind is null").count() == 3


def test_metrics(spark):
    v = spark.createDataFrame([("g", float(k)) for k in range(1, 11)] + [("g", None), ("h", 3.0)], "g string, v double")
    assert {(r.g, r.v) for r in evidence.nearest_rank(v, "v", 0.5, ["g"]).collect()} == {("g", 6.0), ("h", 3.0)}
    ranking = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "query_id bigint, item bigint, rank int")
    gold = spark.createDataFrame([(1, 6), (1, 9), (2, 8)], "query_id bigint, item bigint")
    assert {r.query_id: r.recall for r in evidence.recall_at(ranking, gold, 10).collect()} == {1: 0.5, 2: 0.0}
    assert {r.query_id: r.rr for r in evidence.reciprocal_rank(ranking, gold).collect()} == {1: 0.5, 2: 0.0}
    assert spark.range(1).select(evidence.ratio(F.lit(0), F.lit(0))).first()[0] == 1.0


def test_resolution_stages(spark):
    defs = spark.createDataFrame([(1, 10, "r", "f"), (2, 11, "r", "f"), (3, 12, "r", "g"), (4, 13, "q", "h"), (5, 14, "q", "h")], "symbol_id bigint, file_id bigint, repo_id string, name string")
    uses = spark.createDataFrame([(1, 10, "r", "f"), (2, 99, "r", "f"), (3, 99, "r", "g"), (4, 99, "z", "g"), (5, 99, "z", "h"), (6, 99, "z", "?")], "use_id bigint, file_id bigint, repo_id string, name string")
    assert {r.use_id: (r.symbol_id, r.reason) for r in notes.resolve_names(uses, defs).collect()} == {1: (1, "file"), 2: (None, "ambiguous"), 3: (3, "repo"), 4: (3, "global"), 5: (None, "ambiguous"), 6: (None, "unknown")}


def test_debounce(spark):
    rows = [("k", t) for t in (0, 300, 600, 2000)] + [("m", t) for t in range(0, 4000, 300)] + [(None, 1), ("k", None)]
    got = [tuple(r) for r in feeds.debounce(spark.createDataFrame(rows, "key string, at_ms bigint")).orderBy("key", "started_ms").collect()]
    assert got[:2] == [("k", 0, 1000, 3), ("k", 2000, 2400, 1)]
    assert got[2] == ("m", 0, 2500, 9) and sum(r[3] for r in got[2:]) == 14


def test_tumbling_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(k, f"2025-01-0{k % 3 + 1} 00:00:00", "ab"[k % 2]) for k in range(12)], "event_id bigint, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = feeds.tumbling_counts(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, feeds.tumbling_counts(events).collect()))

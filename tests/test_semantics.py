"""Hand-checked cases of the operators, and odd rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quernel.functions import exprs
from quernel.operators import briefs, clones, evidence, graph, incremental, index, memory, papertrail, refine, resolution, verdicts
from quernel.plans import ranks
from quernel.sources import readers
from quernel.streaming import feeds


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("v"))).collect()]


def test_path_classes(spark):
    generated = {
        "packages/held-core/src/generated/foo.ts": True, "generated/bindings.rs": True, "generated-web/foo.ts": True, "apps/web/src/generated-web/bar.ts": True, "types/index.d.ts": True,
        "src/lib.rs": False, "src/pre-generated-data/seed.rs": False, "src/generator.rs": False,
    }
    assert column(spark, list(generated), exprs.is_generated_path) == list(generated.values())
    tests = {"a/Tests/x.rs": True, "spec/a.rb": True, "a/conftest.py": True, "a/x.test.ts": True, "a/FooTest.kt": True, "a/foo_tests.rs": True, "test_a.py": True, "a/latest.rs": False, "a/contest.py": False, "src/testing/a.rs": False}
    assert column(spark, list(tests), exprs.is_test_path) == list(tests.values())


def test_path_likeness(spark):
    rows = spark.createDataFrame([("src/actors/sync/actor.rs", "src/actors/sync/msg.rs"), ("src/actors/sync/actor.rs", "apps/mobile/src/App.tsx"), ("a", "a"), ("", "")], "a string, b string")
    near, far, same, none = (r[0] for r in rows.select(exprs.path_similarity(F.col("a"), F.col("b"))).collect())
    assert near == pytest.approx(0.65 * 3 / 4 + 0.35 * 4 / 6) and far < near and same == pytest.approx(0.65) and none == 0
    assert column(spark, ["a/b/c/d/e/f/g.rs", "x.rs", "a//b.rs"], exprs.path_bucket) == ["a/b/c/d/e", ".", "a"]


def test_load_buckets(spark):
    edges = spark.createDataFrame([(k, dst, "calls_name", "Exact") for dst, n in ((1, 1), (2, 2), (3, 6), (4, 12)) for k in range(100, 100 + n)], "src bigint, dst bigint, kind string, confidence string")
    assert {r.symbol_id: (r.score, r.bucket) for r in graph.weighted_fan_in(edges).collect()} == {1: (1.0, "low"), 2: (2.0, "medium"), 3: (6.0, "high"), 4: (12.0, "critical")}


def test_ranks_over_ranges(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 30)) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    want = {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r.k: r["rank"] for r in ranks.global_rank(df, F.desc("v"), "k").collect()} == want
    assert {r.k: r["rank"] for r in ranks.top_ranked(df, 9, F.desc("v"), "k").collect()} == {k: n for k, n in want.items() if n <= 9}
    assert ranks.global_rank(df.limit(0), "k").count() == 0
    values = spark.createDataFrame([("g" if k % 3 else None, v) for k, v in rows] + [("g", None)], "g string, v int")
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.v for r in evidence.nearest_rank(values, "v", share, ["g"]).collect()}
        for g in ("g", None):
            own = sorted(v for k, v in rows if (k % 3 != 0) == (g == "g"))
            assert got[g] == own[-(-(len(own) - 1) * int(share * 100) // 100)]


def test_text_classes_and_shapes(spark):
    docs = spark.createDataFrame([(1, "We WILL ship"), (2, "use x instead"), (3, "it must be blocked"), (4, "a concern"), (5, "no longer"), (6, "nothing"), (7, None), (8, "")], "doc_id bigint, text string")
    assert [r.label for r in papertrail.classify_text(docs).orderBy("doc_id").collect()] == ["decision", "rejected_alternative", "constraint", "risk", "obsolete", "context", None, "context"]
    rows = [("thin", "issue", 120), ("review", "issue", 2000)] + [("review", "review", 5)] * 5 + [("review", "comment", 5)] + [("long", "issue", 400), ("few", "issue", 10), ("few", "comment", 9), ("few", "comment", 9), ("odd", None, None)]
    got = {r.thread: r["shape"] for r in papertrail.thread_shapes(spark.createDataFrame(rows, "thread string, kind string, body_len int")).collect()}
    assert got == {"thin": "thin", "review": "review_stream", "long": "investigation", "few": "investigation", "odd": "thin"}


def test_references(spark):
    texts = spark.createDataFrame([(1, "Fixes #12, see o/r#3! GH-4. (closes: #5) #0 #x a/b/c#9 https://h/o/r/pull/77/files"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {(r.project, r.number, r["shape"], r.ref_kind) for r in papertrail.parse_refs(texts, "me/it", "https://h").collect()}
    assert got == {("me/it", 12, "local_number", "closing"), ("o/r", 3, "cross_repo", "reference"), ("me/it", 4, "gh_dash", "unknown"), ("me/it", 5, "local_number", "closing"), ("o/r", 77, "url", "unknown")}


def test_coalesced_hits(spark):
    hits = spark.createDataFrame([(6, 1), (5, 2), (9, 3), (8, 4), (7, 5)], "doc_id bigint, rank int")
    records = spark.createDataFrame([(5, "r5", None), (6, "r5", None), (8, "r5", None), (9, "r9", None)], "doc_id bigint, record string, thread string")
    assert {r.doc_id for r in papertrail.coalesced(hits, records).collect()} == {6, 9, 7}


def test_units_within_a_budget():
    text = "# H\npara one\nstill\n\n```\ncode\n\nmore\n```\n- a\n- b\n\n"
    assert [text[a:b] for a, b in papertrail.segment_blocks(text)] == ["# H", "para one\nstill", "```\ncode\n\nmore\n```", "- a\n- b"]
    assert papertrail.segment_blocks(" \n\n") == [] and papertrail.segment_blocks("```\nopen") == [(0, 8)]
    assert papertrail.tail_aware_budget([5, 5, 5, 5], 100) == [0, 1, 2, 3]
    assert papertrail.tail_aware_budget([5, 5, 5, 5], 11) == [0, 3] and papertrail.tail_aware_budget([50, 1, 1], 20) == [0]
    assert papertrail.tail_aware_budget([5, 2, 9, 9, 3], 10) == [0, 1, 4]


def test_recall_of_queries_without_gold(spark):
    ranking = spark.createDataFrame([(1, "a::x", 1), (1, "b", 2), (2, "c", 1), (3, "c", 1)], "query_id bigint, item string, rank int")
    gold = spark.createDataFrame([(1, "x"), (1, "zz"), (2, "c")], "query_id bigint, item string")
    assert {r.query_id: r.recall for r in evidence.recall_at(ranking, gold, 10, suffix=True).collect()} == {1: 0.5, 2: 1.0, 3: 1.0}
    assert {r.query_id: r.recall for r in evidence.recall_at(ranking, gold, 10).collect()} == {1: 0.0, 2: 1.0, 3: 1.0}


def test_containment_equals_brute_force(spark):
    rng = random.Random(4)
    occ = [(rng.choice("pq"), a := rng.randint(0, 4000), a + rng.choice([0, 1, 3, 60, 64, 65, 700, 3000]), f"s{k}", rng.random() < 0.4, rng.random() < 0.2) for k in range(250)]
    tok = [(k, rng.choice("pqr"), a := rng.randint(0, 4000), a + rng.randint(1, 80)) for k in range(300)] + [(900, "p", None, 5)]
    want = {}
    for i, p, a, b in tok:
        held = [(d, y - x, x, s, y) for q, x, y, s, d, m in occ if a is not None and q == p and x <= a and b <= y and x < y and ((x, y) == (a, b) or not m)]
        if held:
            d, n, x, s, y = min(held)
            want[i] = (s, x, y)
    got = verdicts.containing(spark.createDataFrame(tok, "edge_id bigint, path string, token_start bigint, token_end bigint"), spark.createDataFrame(occ, "path string, start_byte bigint, end_byte bigint, symbol string, is_definition boolean, is_module boolean"))
    assert {r.edge_id: (r.symbol, r.start_byte, r.end_byte) for r in got.collect()} == want
    assert verdicts.comparable(dict.fromkeys(verdicts.PROFILE, 1), dict.fromkeys(verdicts.PROFILE, 1))
    with pytest.raises(ValueError):
        verdicts.report_delta(spark.range(1), dict.fromkeys(verdicts.PROFILE, 1), spark.range(1), dict.fromkeys(verdicts.PROFILE, 2))


def test_enclosing_chunks(spark):
    rng = random.Random(11)
    rows = [(k, rng.randint(1, 3), a := rng.randint(1, 900), a + rng.choice([0, 1, 5, 70, 400])) for k in range(200)] + [(900, None, 1, 2), (901, 1, None, 5)]
    want = {}
    for i, f, a, b in rows:
        held = [(y - x, j) for j, g, x, y in rows if g == f and None not in (f, a, x) and x <= a and b <= y and y - x > b - a]
        if held:
            want[i] = min(held)[1]
    got = index.enclosed(spark.createDataFrame(rows, "id bigint, file_id bigint, start_line int, end_line int"))
    assert {r.inner_id: r.outer_id for r in got.collect()} == want
    assert index.enclosed(spark.createDataFrame([], "id bigint, file_id bigint, start_line int, end_line int")).count() == 0


def test_scratch_is_deleted(spark):
    from quernel.plans import cluster

    cluster.spill_table(spark.range(3), "a").count()
    cluster.clean_scratch(spark)
    assert cluster.spill_table(spark.range(3), "a").count() == 3


def test_clique_cover():
    assert refine.clique_cover([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7), (3, 4, 0.95), (4, 4, 1.0)]) == [(1, 2, 3), (3, 4)]
    rng = random.Random(2)
    for _ in range(40):
        pairs = [(a, b, rng.randint(70, 100) / 100) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.5]
        groups = refine.clique_cover(pairs)
        linked = {(a, b) for a, b, _ in pairs}
        assert all(p in linked for g in groups for p in itertools.combinations(g, 2))
        assert {p for g in groups for p in itertools.combinations(g, 2)} == linked
        assert not any(set(g) < set(h) for g in groups for h in groups)
    many = refine.clique_cover([(a, 1000 + a, 0.9) for a in range(400)])
    assert len(many) == 400


def test_subject_component_and_returns(spark):
    pairs = spark.createDataFrame([(1, 2, 9, 10, 10), (2, 3, 8, 10, 10), (7, 8, 9, 10, 10)], "id_a bigint, id_b bigint, overlap bigint, n_a bigint, n_b bigint")
    assert {r.id: r.hops for r in refine.subject_component(pairs, 1).collect()} == {1: 0, 2: 1, 3: 2}
    assert refine.subject_component(pairs, 99).count() == 0
    assert column(spark, [0.1, 0.3, 0.5, 0.9], refine.coverage_gate, "double") == [0.10, 0.70, 1.0, 1.0]
    rows = spark.createDataFrame([(0.95, 0.9), (0.9, 0.8), (0.6, 0.95), (0.95, 0.69)], "a double, b double")
    assert [r[0] for r in rows.select(refine.confidence(F.col("a"), F.col("b"))).collect()] == ["high", "medium", "low", "low"]


def test_code_tokens_and_long_subsequences(spark):
    assert refine.normalise("fn add(a, b) { return a + b; } // x") == refine.normalise("fn plus(x, y) { return x + y; }\n/* z */")
    assert refine.normalise('let s = "q" + 12;') == ["let", "ID0", "=", "STRING", "+", "NUMBER", ";"]
    rng = random.Random(5)
    long = [f"t{rng.randint(0, 50)}" for _ in range(5_000)]
    prints = spark.createDataFrame([(1, long), (2, long[:2_500] + ["x"] + long[2_500:4_000]), (3, [])], "id bigint, tokens array<string>")
    got = {(r.id_a, r.id_b): r.fidelity for r in clones.lcs_ratio(spark.createDataFrame([(1, 2), (1, 3)], "id_a bigint, id_b bigint"), prints).collect()}
    assert got == {(1, 2): 0.8, (1, 3): 0.0}


def test_templates():
    rng = random.Random(9)
    for _ in range(20):
        base = [f"t{rng.randint(0, 30)}" for _ in range(40)]
        members = [[x for x in base if rng.random() < 0.9] or ["x"] for _ in range(4)]
        made, share = refine.template(members)
        kept = [t for t in made if t is not None]
        for m in members:
            at = iter(m)
            assert all(t in at for t in kept)
        assert 0 <= share <= 1.5
    assert refine.template([["a", "b", "c"], ["a", "x", "c"]]) == (["a", None, "c"], 2 / 3)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "src/sub").mkdir(parents=True)
    (tmp_path / "target").mkdir()
    for name, text in {"src/a.rs": "fn a() {}", "src/sub/b.py": "x = 1", "src/c.bin": "no", "target/d.rs": "no", "README.md": "# é"}.items():
        (tmp_path / name).write_text(text)
    got = {r.path: (r.language, r.size) for r in readers.collect_files(spark, f"file://{tmp_path}", ["^target/"]).collect()}
    assert got == {"src/a.rs": ("rust", 9), "src/sub/b.py": ("python", 5), "README.md": ("markdown", 4)}
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 3)], "k bigint, t string, n int")
    readers.write_text_store(rows, f"{tmp_path}/store")
    assert readers.read_declared(spark, f"{tmp_path}/store", "k bigint, t string").orderBy("k").collect() == rows.select("k", "t").orderBy("k").collect()
    with pytest.raises(ValueError):
        readers.read_declared(spark, f"{tmp_path}/store", "k string, z int")
    readers.as_json(rows).write.text(f"{tmp_path}/json")
    assert readers.read_declared(spark, f"{tmp_path}/json", rows.schema, "json").orderBy("k").collect() == rows.orderBy("k").collect()
    names = spark.createDataFrame([(1, "x")], "id bigint, value string")
    edges = spark.createDataFrame([(1, None), (9, 1)], "from_id bigint, to_id bigint")
    assert sorted(map(str, resolution.decoded(edges, names, ["from", "to"]).collect())) == sorted(map(str, spark.createDataFrame([("x", None), (None, "x")], "`from` string, `to` string").collect()))


def test_digest_moves_like_a_fresh_one(spark):
    files = spark.createDataFrame([("r", f"p{k}", str(k), "source" if k % 5 else "deleted", k) for k in range(200)] + [("q", "a", "1", None, 1)], "repo_id string, path string, sha256 string, kind string, k int")
    whole = {r.repo_id: r for r in index.content_digest(files).collect()}
    moved = {r.repo_id: r for r in index.moved_digest(index.content_digest(files.where("k < 150")), files.where("k >= 100"), files.where("k between 100 and 149")).collect()}
    assert {k: tuple(v) for k, v in whole.items()} == {k: tuple(v) for k, v in moved.items()}
    assert all(0 <= int(r.lane_1) < 2**64 for r in whole.values()) and whole["r"].n == 160


def test_chunk_spans_tile_sources():
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice(["x = é\n", "\n", "  y\n", "# h\n"]) for _ in range(rng.randint(0, 500)))
        symbols = [(f"s{k}", a := rng.randint(1, 480), a + rng.randint(0, 200)) for k in range(rng.randint(0, 4))]
        for language, kind in (("rust", "source"), ("markdown", "docs"), ("rust", "generated")):
            spans = incremental.chunk_spans("a/b.rs", language, kind, text, symbols)
            lines = text.count("\n")
            data = text.encode()
            for _, _, a, b, x, y in spans:
                assert 0 <= a < b <= len(data) and 1 <= x <= y <= lines and data[a:b].decode().count("\n") == y - x + 1
            held = {n for _, _, _, _, x, y in spans for n in range(x, y + 1)}
            assert all(n in held or not line.strip() for n, line in enumerate(text.split("\n")[:-1], 1))
            assert all(y - x < 160 for _, _, _, _, x, y in spans) or language == "markdown"
    assert [s[1] for s in incremental.chunk_spans("a/n.md", "markdown", "docs", "# A\nx\n## B\ny\n", [])] == ["A", "A > B"]
    assert incremental.chunk_spans("a.rs", "rust", "source", "", []) == []
    assert incremental.chunk_spans("d/a.rs", "rust", "source", "\n\n", []) == [("code", "a.rs", 0, 2, 1, 2)]


def test_reviews_and_dead_roots(spark):
    findings = spark.createDataFrame([("abc1", "open", None), ("abd2", "resolved", None), ("abe3", "open", None)], "finding_id string, status string, reviewed_at_ms bigint")
    done = {r.finding_id: (r.status, r.reviewed_at_ms) for r in memory.review(findings, "abc", "accept", 7).collect()}
    assert done["abc1"] == ("accepted", 7) and done["abe3"] == ("open", None)
    for prefix in ("", "zzz", "ab", "abd"):
        with pytest.raises(ValueError):
            memory.review(findings, prefix, "dismiss", 1)
    notes = spark.createDataFrame([(k, "obsolete" if k == 1 else "active") for k in range(1, 7)], "note_id bigint, status string")
    bound = spark.createDataFrame([(6, "gone")], "note_id bigint, anchor_status string")
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 9), (4, 6), (3, 4)], "note_id bigint, parent bigint")
    got = {r.note_id: (r.via, r.root) for r in memory.dependents_of_dead(notes, bound, links, spark.createDataFrame([(2, 1)], "note_id bigint, target bigint")).collect()}
    assert got == {3: (2, 1), 4: (3, 1)}


def test_operators_on_empty_tables(spark):
    edges = spark.createDataFrame([], "edge_id bigint, from_symbol_id bigint, to_symbol_id bigint, from_name string, to_name string, target_qualified_name string, kind string, confidence string, hidden int, source_file_id bigint")
    symbols = spark.createDataFrame([], "symbol_id bigint, name string, qualified_name string, file_id bigint")
    seed = resolution.Seed("a::b")
    assert resolution.hops(edges, symbols, seed, True, 5).count() == 0
    only = resolution.summary(edges, symbols, seed, True, 5).first()
    assert only.total == 0 and only.completeness_risk == "medium" and only.false_positive_risk == "low"
    assert verdicts.verdict_counts(spark.createDataFrame([], "edge_id bigint, kind string")).first().total == 0
    pairs = spark.createDataFrame([], "a bigint, b bigint, t bigint, g bigint, score double")
    metrics = spark.createDataFrame([], "file_id bigint, repo_id string, path string, language string, kind string, generated int, " + ", ".join(f"{c} bigint" for c in briefs.COUNTS))
    assert briefs.file_clusters(metrics, pairs).count() == 0 and briefs.file_brief(metrics, "spine").count() == 0


def test_maintenance_pass():
    now = [0.0]

    def stage(cost, changed):
        def run():
            now[0] += cost
            return changed

        return run

    steps = [("a", stage(5, True)), ("b", stage(6, False)), ("c", stage(1, True))]
    assert feeds.maintenance_pass(steps, 10, lambda: now[0]) == [("a", "done"), ("b", "idle"), ("c", "deferred")]


def test_overfetch_and_probe(spark):
    assert [resolution.overfetch(n) for n in (1, 100, 2_000, 9_000)] == [200, 400, 5_000, 9_000]
    rows, more = resolution.probe(spark.range(7), 5, "id")
    assert rows.count() == 5 and more and not resolution.probe(spark.range(5), 5, "id")[1]

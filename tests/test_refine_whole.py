"""Clone groups, templates and returns over whole classes, whatever their size."""

import itertools

from pyspark.sql import functions as F

from quernel.operators import refine


def test_groups_stay_cliques_however_many_there_are():
    triples = [(k, 1_000 + k, 2_000 + k) for k in range(400)]
    pairs = [(a, b, 0.9) for t in triples for a, b in itertools.combinations(t, 2)]
    assert refine.clique_cover(pairs) == triples
    # each a triple that shares a member with the next one: a component of its own
    chain = [(2 * k, 2 * k + 1, 2 * k + 2) for k in range(400)]
    assert refine.clique_cover([(a, b, 0.9) for t in chain for a, b in itertools.combinations(t, 2)]) == chain
    assert refine.clique_cover([]) == []


def test_a_component_of_any_size_is_covered_by_cliques(spark):
    n = 640  # 204,480 pairs
    pairs = spark.range(n).select(F.col("id").alias("id_a")).join(spark.range(n).select(F.col("id").alias("id_b")), F.col("id_a") < F.col("id_b"))
    pairs = pairs.unionByName(spark.createDataFrame([(n - 1, n)], "id_a bigint, id_b bigint"))
    pairs = pairs.unionByName(spark.createDataFrame([(1_000, 1_001), (1_000, 1_002)], "id_a bigint, id_b bigint"))
    rows = refine.coherent_groups(pairs.select("*", F.lit(9).alias("overlap"), F.lit(10).alias("n_a"), F.lit(10).alias("n_b"))).collect()
    got = sorted((r.class_id, r.group_no, tuple(r.members)) for r in rows)
    assert got == [(0, 0, tuple(range(n))), (0, 1, (n - 1, n)), (1_000, 0, (1_000, 1_001)), (1_000, 1, (1_000, 1_002))]


def _class(n):
    """60 texts of a class, of which those after the 50th have other tokens at the end."""
    return [(k, [f"t{x}" for x in range(20)] + [f"u{x}{'' if k < 50 else 'z'}" for x in range(80)]) for k in range(n)]


def test_templates_read_every_member(spark):
    rows = [*_class(60), *((100 + k, ["a", "b", "c"][: 2 + (k < 70)]) for k in range(80))]
    prints = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    classes = spark.createDataFrame([(k, 0 if k < 60 else 100) for k, _ in rows], "id bigint, class_id bigint")
    got = {r.class_id: (r.template, r.n_holes, r.share) for r in refine.class_templates(classes, prints.repartition(3)).collect()}
    assert got == {0: (" ".join(f"t{x}" for x in range(20)) + " …", 1, 0.2), 100: ("a b …", 1, 0.6667)}
    assert refine.template(iter([["a", "b"], ["c"], ["a", "b"]])) == ([None], 0.0)


def test_returns_are_gated_by_templates_of_all_members(spark):
    prints = spark.createDataFrame(_class(60), "id bigint, tokens array<string>")
    share = refine.class_templates(prints.select("id", F.lit(0).cast("bigint").alias("class_id")), prints).select("class_id", "share")
    metrics = spark.createDataFrame([(0, 60, "high", 100.0), (1, 2, "high", 50.0)], "class_id bigint, n_members bigint, confidence string, roi double")
    got = [(r.class_id, r.refined, r.roi, r["rank"]) for r in refine.find_clones(metrics, 2, share).orderBy("rank").collect()]
    assert got == [(1, True, 50.0, 1), (0, True, 10.0, 2)]

"""Graph operators: connected components, PageRank, one-hop traversal, fan-in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.exprs import RANK_CONFIDENCE, RANK_KIND, lookup, round4
from quernel.plans.cluster import drop_spilled, spill_table
from quernel.plans.ranks import global_rank
from quernel.sources.projections import SQL_EDGES, SQL_SYMBOLS, edges, symbols


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that links reach, over ``edges`` (src, dst), undirected.

    Alternates large-star and small-star rounds, which need O(log n) rounds on paths and never gather a
    component in one task: a node's neighbours are only joined with the node's minimum. Null ends and loops
    are ignored; nodes without an edge to another don't come out. Each round is written once.
    """
    links = edges.where("src is not null and dst is not null and src <> dst")
    links = spill_table(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "component-links")
    size = links.count()
    while True:
        # large star: every larger neighbour of u is linked to the smallest of u's neighbourhood
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = spill_table(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "component-links")
        now = after.count()
        same = now == size and after.join(links, ["u", "v"], "left_anti").isEmpty()
        drop_spilled(links)
        links, size = after, now
        if same:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v")).distinct()


def ranked_edges(edge_table: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): kind weight times confidence weight; parallel edges are added up.

    ``verdicts`` (edge_id, effect, target) of a compiler override: ``drop`` removes the edge, ``confirm`` weighs it
    1.2, ``retarget`` also moves it to ``target``; then ``edge_table`` needs edge_id. Edges without a target are dropped.
    """
    kind, factor, dst = lookup(F.col("kind"), RANK_KIND, 1.0), lookup(F.col("confidence"), RANK_CONFIDENCE, 1.0), F.col("dst")
    if verdicts is not None:
        edge_table = edge_table.join(verdicts.select("edge_id", "effect", "target"), "edge_id", "left").where(~F.col("effect").eqNullSafe("drop"))
        factor = F.when(F.col("effect").isNotNull(), 1.2).otherwise(factor)
        dst = F.when(F.col("effect") == "retarget", F.col("target")).otherwise(dst)
    weighted = edge_table.select("src", dst.alias("dst"), F.round(kind * factor * 1000).cast("bigint").alias("w")).where("src is not null and dst is not null")
    return weighted.groupBy("src", "dst").agg((F.sum("w") / 1000).alias("weight"))


def pagerank(edge_table: DataFrame, damping: float = 0.85, most: int = 100, tolerance: float = 1e-6, personal: DataFrame | None = None) -> DataFrame:
    """(node, rank) of weighted edges (src, dst, weight); ranks add up to 1.

    The mass of nodes without out-weight goes to the teleport distribution: uniform, or ``personal`` (node,
    weight) scaled to 1 where any weight is positive. Stops when the ranks move less than ``tolerance`` in
    total. Each round is written once, so a plan holds one round; it shuffles one row per node and target.
    """
    links = edge_table.where("weight > 0")
    out = links.groupBy("src").agg(F.sum("weight").alias("total"))
    links = spill_table(links.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "pagerank-links")
    nodes = edge_table.select(F.col("src").alias("node")).union(edge_table.select("dst")).distinct()
    nodes = nodes.join(links.select(F.col("src").alias("node")).distinct().withColumn("sends", F.lit(True)), "node", "left")
    if personal is not None:
        wanted = personal.where("weight > 0 and weight < double('infinity')").select("node", "weight")
        nodes = nodes.join(wanted, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        sums = nodes.agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n")).first()
    else:
        sums = None
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    share = F.col("weight") / F.lit(float(sums["s"])) if sums and sums["s"] else F.lit(1.0 / n)
    nodes = spill_table(nodes.select("node", F.coalesce("sends", F.lit(False)).alias("sends"), share.alias("teleport")), "pagerank-nodes")
    ranks, last = nodes.withColumn("rank", F.lit(1.0 / n)), None
    for _ in range(most):
        lost = ranks.where(~F.col("sends")).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        fresh = (
            ranks.select("node", "sends", "teleport", F.col("rank").alias("old"))
            .join(given, "node", "left")
            .join(F.broadcast(lost))
            .select("node", "sends", "teleport", "old", ((1 - damping) * F.col("teleport") + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") * F.col("teleport"))).alias("rank"))
        )
        fresh = spill_table(fresh, "ranks", last)
        moved = fresh.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved")).first()["moved"]
        ranks, last = fresh.drop("old"), fresh
        if moved < tolerance:
            break
    return ranks.select("node", "rank")


def fan_counts(edge_table: DataFrame, symbol_table: DataFrame) -> DataFrame:
    """(file_id, fan_in, fan_out): edges into and out of the symbols of every file that has any."""
    owner = symbol_table.select("symbol_id", "file_id")
    into = edge_table.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).join(owner.withColumnRenamed("symbol_id", "dst"), "dst").groupBy("file_id").agg(F.sum("n").alias("fan_in"))
    out = edge_table.groupBy("src").agg(F.count(F.lit(1)).alias("n")).join(owner.withColumnRenamed("symbol_id", "src"), "src").groupBy("file_id").agg(F.sum("n").alias("fan_out"))
    return into.join(out, "file_id", "full_outer").select("file_id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


#: Weighted fan-in from which a symbol is in a bucket, ``low`` below (fixed values).
LOAD_BUCKETS = {"medium": 2.0, "high": 5.0, "critical": 12.0}


def weighted_fan_in(edge_table: DataFrame) -> DataFrame:
    """(symbol_id, score, bucket): added weight of the edges into a symbol; medium from 2, high from 5, critical from 12."""
    score = ranked_edges(edge_table).groupBy(F.col("dst").alias("symbol_id")).agg(F.sum(F.round(F.col("weight") * 1000).cast("bigint")).alias("w"))
    score = score.withColumn("score", round4(F.col("w") / 1000))
    bucket = F.lit("low")
    for name, floor in LOAD_BUCKETS.items():
        bucket = F.when(F.col("score") >= floor, name).otherwise(bucket)
    return score.select("symbol_id", "score", bucket.alias("bucket"))


#: Order of edge confidence in traversals (fixed values).
CONFIDENCE_RANK = {"Exact": 0.0, "Syntactic": 1.0, "NameOnly": 2.0, "Ambiguous": 3.0}


def one_hop(edge_table: DataFrame, symbol_table: DataFrame, node: int, callers: bool, kinds: list[str] | None = None) -> DataFrame:
    """Callers or callees of a symbol: distinct (symbol_id, name, kind, confidence, n_edges, rank), best first.

    Order: confidence, kind, name, id. All hops come out; a caller that pages adds its own limit.
    """
    near, far = ("dst", "src") if callers else ("src", "dst")
    own = edge_table.where(F.col(near) == node)
    if kinds:
        own = own.where(F.col("kind").isin(kinds))
    hops = own.groupBy(F.col(far).alias("symbol_id"), "kind", "confidence").agg(F.count(F.lit(1)).alias("n_edges")).join(symbol_table.select("symbol_id", "name"), "symbol_id")
    return global_rank(hops, lookup(F.col("confidence"), CONFIDENCE_RANK, 4.0), "kind", "name", "symbol_id", "confidence")


def traversal_summary(edge_table: DataFrame) -> DataFrame:
    """Per target: edges in all, exact, name-only and by kind, with a risk of false positives by the name-only share."""
    out = edge_table.groupBy(F.col("dst").alias("symbol_id")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col("confidence") == "Exact").cast("bigint")).alias("exact"),
        F.sum((F.col("confidence") == "NameOnly").cast("bigint")).alias("name_only"),
        F.sum((F.col("kind") == "calls_name").cast("bigint")).alias("calls"),
        F.countDistinct("src").alias("n_sources"),
    )
    risk = F.when(F.col("name_only") * 2 > F.col("total"), "high").when(F.col("name_only") > 0, "medium").otherwise("low")
    return out.withColumn("false_positive_risk", risk)


def siblings(symbol_table: DataFrame, seeds: DataFrame) -> DataFrame:
    """(symbol_id, sibling_id): the other symbols of the file of each symbol of ``seeds`` (symbol_id)."""
    a = symbol_table.join(seeds.select("symbol_id").distinct(), "symbol_id", "left_semi").select("file_id", "symbol_id")
    b = symbol_table.select("file_id", F.col("symbol_id").alias("sibling_id"))
    return a.join(b, "file_id").where("symbol_id <> sibling_id").select("symbol_id", "sibling_id")


def cross_file_pairs(edge_table: DataFrame, symbol_table: DataFrame) -> DataFrame:
    """(file_a, file_b, n): edges between symbols of two files, either way."""
    owner = symbol_table.select("symbol_id", "file_id")
    rows = edge_table.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).join(owner.toDF("src", "f"), "src").join(owner.toDF("dst", "g"), "dst").where("f <> g")
    return rows.groupBy(F.least("f", "g").alias("file_a"), F.greatest("f", "g").alias("file_b")).agg(F.sum("n").alias("n"))


def impact_surface(edge_table: DataFrame, symbol_table: DataFrame, node: int) -> DataFrame:
    """(symbol_id, evidence, rank): union of the lanes exact, callers, callees, imports and siblings around a symbol.

    A symbol comes out once, with its lanes joined; order: best lane, number of lanes, id.
    """
    lane = lambda df, k, name: df.select("symbol_id", F.lit(k).alias("k"), F.lit(name).alias("lane"))
    calls = ["calls_name", "references_type"]
    hop = lambda callers, kinds: edge_table.where((F.col("dst" if callers else "src") == node) & F.col("kind").isin(kinds)).select(F.col("src" if callers else "dst").alias("symbol_id")).distinct()
    exact = symbol_table.where(F.col("symbol_id") == node)
    mates = siblings(symbol_table, exact).select(F.col("sibling_id").alias("symbol_id"))
    every = lane(exact, 0, "0exact").unionByName(lane(hop(True, calls), 1, "1caller")).unionByName(lane(hop(False, calls), 2, "2callee")).unionByName(lane(hop(True, ["imports"]), 3, "3import")).unionByName(lane(mates, 4, "4sibling"))
    joined = every.groupBy("symbol_id").agg(F.min("k").alias("k"), F.array_join(F.sort_array(F.collect_set("lane")), ",").alias("evidence"), F.countDistinct("lane").alias("n"))
    return global_rank(joined, "k", F.desc("n"), "symbol_id").select("symbol_id", "evidence", "rank")


def _two(spark, sf_dir):
    return edges(spark, sf_dir), symbols(spark, sf_dir)


def q_pagerank(spark, sf_dir):
    ranks = pagerank(ranked_edges(edges(spark, sf_dir)))
    return ranks.select("node", F.round("rank", 6).alias("rank"))


def q_components(spark, sf_dir):
    return connected_components(edges(spark, sf_dir).where("confidence = 'Exact' and kind = 'calls_name'"))


QUERIES = {
    "pagerank": q_pagerank,
    "edge_components": q_components,
    "edge_weights": lambda s, d: ranked_edges(edges(s, d)).select("src", "dst", round4(F.col("weight")).alias("weight")),
    "fan_counts": lambda s, d: fan_counts(*_two(s, d)),
    "weighted_fan_in": lambda s, d: weighted_fan_in(edges(s, d)),
    "find_callers": lambda s, d: one_hop(*_two(s, d), 3, True),
    "trace_callees": lambda s, d: one_hop(*_two(s, d), 3, False, ["calls_name", "imports"]),
    "traversal_summary": lambda s, d: traversal_summary(edges(s, d)),
    "file_siblings": lambda s, d: siblings(symbols(s, d), symbols(s, d).where("symbol_id % 100 = 0")),
    "cross_file_pairs": lambda s, d: cross_file_pairs(*_two(s, d)),
    "impact_surface": lambda s, d: impact_surface(*_two(s, d), 3),
}
_E = f"WITH e AS ({SQL_EDGES}), s AS ({SQL_SYMBOLS})"
_W = """, w AS (SELECT src, dst, sum(CASE kind WHEN 'calls_name' THEN 10 WHEN 'references_type' THEN 7 ELSE 3 END * CASE confidence WHEN 'Exact' THEN 100 ELSE 40 END) / CAST(1000 AS DOUBLE) AS weight FROM e GROUP BY ALL)"""


def _pagerank_sql(rounds: int) -> str:
    sql = f"""{_E}{_W}, l AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM w),
nodes AS (SELECT src AS node FROM w UNION SELECT dst FROM w), r0 AS (SELECT node, CAST(1 AS DOUBLE) / (SELECT count(*) FROM nodes) AS rank FROM nodes)"""
    for k in range(1, rounds + 1):
        sql += f""", g{k} AS (SELECT dst AS node, sum(rank * share) AS given FROM l JOIN r{k - 1} ON src = node GROUP BY dst),
r{k} AS MATERIALIZED (SELECT node, CAST(0.15 AS DOUBLE) / (SELECT count(*) FROM nodes) + CAST(0.85 AS DOUBLE) * (coalesce(given, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM l)) / (SELECT count(*) FROM nodes)) AS rank FROM nodes LEFT JOIN g{k} USING (node))"""
    return sql + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


_HOP = """ SELECT symbol_id, kind, confidence, n_edges, name, CAST(row_number() OVER (ORDER BY CASE confidence WHEN 'Exact' THEN 0 ELSE 2 END, kind, name, symbol_id) AS INTEGER) AS rank
FROM (SELECT {far} AS symbol_id, kind, confidence, count(*) AS n_edges FROM e WHERE {near} = 3 {more} GROUP BY ALL) JOIN s USING (symbol_id)"""
SQL = {
    "pagerank": _pagerank_sql(10),
    "edge_components": f"""{_E}, x AS (SELECT DISTINCT src, dst FROM e WHERE confidence = 'Exact' AND kind = 'calls_name'), y AS (SELECT src, dst FROM x UNION SELECT dst, src FROM x),
b AS (SELECT DISTINCT least(src, dst) AS a FROM x) SELECT node, min(component) AS component FROM (
  WITH RECURSIVE r(node, component) AS (SELECT src, src FROM y UNION SELECT y.dst, r.component FROM r JOIN y ON y.src = r.node WHERE r.component < y.dst) SELECT * FROM r) GROUP BY node""",
    "edge_weights": f"{_E}{_W} SELECT src, dst, floor(weight * 10000 + 0.5) / 10000 AS weight FROM w",
    "fan_counts": f"""{_E}, i AS (SELECT file_id, count(*) AS fan_in FROM e JOIN s ON dst = symbol_id GROUP BY file_id), o AS (SELECT file_id, count(*) AS fan_out FROM e JOIN s ON src = symbol_id GROUP BY file_id)
SELECT file_id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM i FULL JOIN o USING (file_id)""",
    "weighted_fan_in": f"""{_E}{_W}, f AS (SELECT dst AS symbol_id, floor(CAST(sum(CAST(round(weight * 1000) AS BIGINT)) AS DOUBLE) / 1000 * 10000 + 0.5) / 10000 AS score FROM w GROUP BY dst)
SELECT symbol_id, score, CASE WHEN score >= 12 THEN 'critical' WHEN score >= 5 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS bucket FROM f""",
    "find_callers": _E + _HOP.format(far="src", near="dst", more=""),
    "trace_callees": _E + _HOP.format(far="dst", near="src", more="AND kind IN ('calls_name', 'imports')"),
    "traversal_summary": f"""{_E}, t AS (SELECT dst AS symbol_id, count(*) AS total, CAST(sum(CASE WHEN confidence = 'Exact' THEN 1 ELSE 0 END) AS BIGINT) AS exact, CAST(sum(CASE WHEN confidence = 'NameOnly' THEN 1 ELSE 0 END) AS BIGINT) AS name_only,
  CAST(sum(CASE WHEN kind = 'calls_name' THEN 1 ELSE 0 END) AS BIGINT) AS calls, count(DISTINCT src) AS n_sources FROM e GROUP BY dst)
SELECT *, CASE WHEN name_only * 2 > total THEN 'high' WHEN name_only > 0 THEN 'medium' ELSE 'low' END AS false_positive_risk FROM t""",
    "file_siblings": f"{_E} SELECT a.symbol_id, b.symbol_id AS sibling_id FROM s a JOIN s b ON a.file_id = b.file_id AND a.symbol_id <> b.symbol_id AND a.symbol_id % 100 = 0",
    "cross_file_pairs": f"{_E} SELECT least(a.file_id, b.file_id) AS file_a, greatest(a.file_id, b.file_id) AS file_b, count(*) AS n FROM e JOIN s a ON src = a.symbol_id JOIN s b ON dst = b.symbol_id WHERE a.file_id <> b.file_id GROUP BY ALL",
    "impact_surface": f"""{_E}, x AS (SELECT symbol_id, 0 AS k, '0exact' AS lane FROM s WHERE symbol_id = 3
UNION SELECT src, 1, '1caller' FROM e WHERE dst = 3 AND kind IN ('calls_name', 'references_type') UNION SELECT dst, 2, '2callee' FROM e WHERE src = 3 AND kind IN ('calls_name', 'references_type')
UNION SELECT src, 3, '3import' FROM e WHERE dst = 3 AND kind = 'imports' UNION SELECT b.symbol_id, 4, '4sibling' FROM s a JOIN s b ON a.file_id = b.file_id AND a.symbol_id = 3 AND b.symbol_id <> 3),
g AS (SELECT symbol_id, min(k) AS k, count(*) AS n, string_agg(lane, ',' ORDER BY lane) AS evidence FROM x GROUP BY symbol_id)
SELECT symbol_id, evidence, CAST(row_number() OVER (ORDER BY k, n DESC, symbol_id) AS INTEGER) AS rank FROM g""",
}

"""Clone classes refined: cliques, medoids and return, confidence, the class of one text, clones of a text that isn't indexed, changes of a clone graph."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.exprs import terms
from quernel.operators import clones
from quernel.operators.clones import THETA, bags, check_theta, clone_classes, clone_pairs, fingerprints, lcs_ratio
from quernel.plans.cluster import cut, spill_table
from quernel.plans.ranks import top_ranked
from quernel.sources.tables import table

#: Refined classes of an answer; shares of a class that a template covers below which its return counts less, and what then counts; floors of confidence
#: (fixed values).
MOST_REFINED = 50
STRONG_GATE, MILD_GATE, STRONG_KEEPS, MILD_KEEPS = 0.3, 0.5, 0.10, 0.70
HIGH_FLOOR, LOW_CEILING = 0.9, 0.7
#: Links whose places are looked up together; members of groups that leave a task together.
TURN, SENT = 1 << 16, 1 << 18


def normalise(code: str) -> list[str]:
    """Tokens of a source without comments: identifiers by their first place (``ID0``, ``ID1``), numbers and strings by kind, words of the language kept."""
    names: dict[str, str] = {}
    out = []
    for m in _TOKEN.finditer(code):
        kind, text = m.lastgroup, m.group()
        if kind == "word":
            out.append(text if text in _KEYWORDS else names.setdefault(text, f"ID{len(names)}"))
        elif kind in ("number", "string"):
            out.append(kind.upper())
        elif kind == "sign":
            out.append(text)
    return out


_TOKEN = re.compile(r"""(?P<note>//[^\n]*|/\*[\s\S]*?\*/|\#[^\n]*)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>[^\w\s])""")
#: Words that are no names in any of the languages read here (fixed values).
_KEYWORDS = frozenset(
    "and as async await break case catch class const continue def default defer do elif else enum except export extends extern false finally fn for from fun func function if impl import in interface is let loop "
    "match mod mut new nil none not null or package pass private protected pub public raise return self static struct super switch this throw trait true try type use val var void where while with yield".split()
)


def code_fingerprints(sources: DataFrame, least: int = clones.LEAST_TOKENS) -> DataFrame:
    """(id, language, struct_hash, n_tokens, tokens) of sources (id, language, text) by their normalised tokens; see ``clones.fingerprints``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b.id, "language": b.language, "tokens": [normalise(t or "") for t in b.text]})

    made = sources.select("id", F.coalesce("language", F.lit("")).alias("language"), "text").mapInPandas(run, "id bigint, language string, tokens array<string>").withColumn("n_tokens", F.size("tokens"))
    return made.where(F.col("n_tokens") >= least).withColumn("struct_hash", F.sha2(F.concat_ws("\u0001", "tokens"), 256)).select("id", "language", "struct_hash", "n_tokens", "tokens")


def clique_cover(pairs: list[tuple[int, int, float]]) -> list[tuple[int, ...]]:
    """Maximal groups of members that are all linked; a member may be in several.

    The most similar pair (ties: the smaller ids) that no group holds starts a group, which takes every member, by id, that is linked to all in it.
    """
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    return [tuple(g.tolist()) for g in grown_cliques(a, b, np.array([p[2] for p in pairs], np.float64))]


def grown_cliques(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> Iterator[np.ndarray]:
    """The groups of ``clique_cover`` in their order, of links given as arrays; memory is in proportion to the links and the groups.

    A link is done once a group holds both of its ends, so each group is another clique that no member extends, and none is part of another.
    """
    ids = np.unique(np.concatenate([a, b]))
    m = len(ids)
    link = np.searchsorted(ids, np.minimum(a, b)) * m + np.searchsorted(ids, np.maximum(a, b))
    link, last = np.unique(link[::-1], return_index=True)  # the last of equal pairs counts
    s = s[::-1][last]
    other = link // m != link % m
    link = link[other][np.argsort(-s[other], kind="stable")]
    both = np.concatenate([link, link % m * m + link // m])
    both.sort()
    near, start = (both % m).astype(np.int32), np.searchsorted(both, np.arange(m + 1) * m).tolist()
    done = np.zeros(len(both), bool)

    def common(some: np.ndarray, x: int) -> np.ndarray:
        row = near[start[x] : start[x + 1]]
        return some[row.take(row.searchsorted(some), mode="clip") == some]

    groups: list[bytes] = []
    for k in range(0, len(link), TURN):
        turn = link[k : k + TURN]
        at = np.searchsorted(both, turn)
        fresh = ~done[at]
        for place, own in zip(at[fresh].tolist(), turn[fresh].tolist(), strict=True):
            if done[place]:
                continue
            group = [*divmod(own, m)]
            shared = common(near[start[group[0]] : start[group[0] + 1]], group[1])
            while len(shared):
                group.append(int(shared[0]))
                shared = common(shared[1:], group[-1])
            held = np.array(sorted(group), np.int32)
            for n, x in enumerate(held[:-1].tolist(), 1):
                done[start[x] + near[start[x] : start[x + 1]].searchsorted(held[n:])] = True
            groups.append(held.astype(">u4").tobytes())  # in the order of the members
    groups.sort()
    for g in groups:
        yield ids[np.frombuffer(g, ">u4")]


def keyed_parts(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[int, Iterator[pd.DataFrame]]]:
    """Each value of ``key`` with its rows in parts, of batches that are sorted by it."""

    def parts() -> Iterator[tuple[int, pd.DataFrame]]:
        for b in batches:
            k = b[key].to_numpy()
            ends = [*(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(b)]
            yield from ((k[x], b.iloc[x:y]) for x, y in zip([0, *ends], ends, strict=False) if x < y)

    for value, own in groupby(parts(), lambda x: x[0]):
        yield value, (part for _, part in own)


def by_class(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with those of a class in one task, one after the other and in ``order``; small classes aren't all put into one task."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "class_id").sortWithinPartitions("class_id", *order)


def coherent_groups(pairs: DataFrame) -> DataFrame:
    """(class_id, group_no, members): the clique cover of every component of verified pairs (id_a, id_b, overlap, n_a, n_b), numbered by members.

    One task covers a component of any size and holds its pairs as arrays.
    """
    scored = pairs.select("id_a", "id_b", (F.col("overlap") / F.greatest("n_a", "n_b")).alias("s"))
    rows = scored.join(clone_classes(pairs).withColumnRenamed("id", "id_a"), "id_a").select("class_id", "id_a", "id_b", "s")

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for c, own in keyed_parts(batches, "class_id"):
            a, b, s = (np.concatenate(x) for x in zip(*((p.id_a.to_numpy(), p.id_b.to_numpy(), p.s.to_numpy()) for p in own), strict=True))
            for k, g in enumerate(grown_cliques(a, b, s)):
                out.append((c, k, g))
                held += len(g)
                if held >= SENT:
                    yield pd.DataFrame(out, columns=["class_id", "group_no", "members"])
                    out, held = [], 0
        yield pd.DataFrame(out, columns=["class_id", "group_no", "members"])

    return by_class(rows).mapInPandas(cover, "class_id bigint, group_no bigint, members array<bigint>")


def template(members: Iterable[list[str]]) -> tuple[list[str | None], float]:
    """What all members share in order, with None where some of them differ, and its share of the median member.

    The first member is reduced to what it has in common with each other one in turn (by longest matching blocks), so the template is a subsequence of all.
    Members are read once; only the first one and all lengths are kept.
    """
    from difflib import SequenceMatcher

    members = iter(members)
    first = list(next(members))
    kept, sizes = list(range(len(first))), [len(first)]
    for other in members:
        sizes.append(len(other))
        if kept:  # else nothing is left to be reduced
            own = [first[k] for k in kept]
            kept = [kept[b.a + n] for b in SequenceMatcher(None, own, list(other), autojunk=False).get_matching_blocks() for n in range(b.size)]
    out: list[str | None] = []
    last = -1
    for k in kept:
        if k > last + 1:
            out.append(None)
        out.append(first[k])
        last = k
    if last < len(first) - 1:
        out.append(None)
    median = sorted(sizes)[len(sizes) // 2]
    return out, len(kept) / median if median else 0.0


def class_templates(classes: DataFrame, prints: DataFrame) -> DataFrame:
    """(class_id, template, n_holes, share) over all members of every class (id, class_id), by id; holes show as ``\u2026``.

    A class goes through one task, which holds a batch of its members at a time.
    """
    own = classes.select("id", "class_id").join(prints.select("id", "tokens"), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c, parts in keyed_parts(batches, "class_id"):
            made, share = template(tokens for part in parts for tokens in part.tokens)
            row = (c, " ".join("\u2026" if t is None else t for t in made), made.count(None), round(share, 4))
            yield pd.DataFrame([row], columns=["class_id", "template", "n_holes", "share"])

    return by_class(own, "id").mapInPandas(run, "class_id bigint, template string, n_holes int, share double")


def confidence(fidelity, similarity) -> Column:
    """``high`` where both the subsequence ratio and the least similarity reach 0.9, ``low`` where either is below 0.7."""
    return F.when((fidelity >= HIGH_FLOOR) & (similarity >= HIGH_FLOOR), "high").when((fidelity < LOW_CEILING) | (similarity < LOW_CEILING), "low").otherwise("medium")


def class_metrics(pairs: DataFrame, fidelity: DataFrame, prints: DataFrame, spread: DataFrame) -> DataFrame:
    """Per class of representatives: members, links, least similarity, greatest containment, medoid, least similarity to it, fidelity, confidence, return.

    Members that aren't linked count with no similarity beyond the links, so a class that isn't a clique shows by ``n_pairs``. The medoid has the
    greatest sum of similarities (ties: the smallest id). ``spread``: id, module; the return is modules x members x the medoid's length x least similarity.
    """
    classes = spill_table(clone_classes(pairs), "clone-classes")
    sim = F.col("overlap") / F.greatest("n_a", "n_b")
    scored = pairs.select("id_a", "id_b", sim.alias("s"), (F.col("overlap") / F.least("n_a", "n_b")).alias("c")).join(fidelity, ["id_a", "id_b"]).join(classes.withColumnRenamed("id", "id_a"), "id_a")
    scored = spill_table(scored, "clone-scores")
    rolled = scored.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("s").alias("least"), F.max("c").alias("contained"), F.min("fidelity").alias("fidelity"))
    both = scored.select("class_id", F.col("id_a").alias("id"), "s").unionByName(scored.select("class_id", F.col("id_b").alias("id"), "s"))
    sums = both.groupBy("class_id", "id").agg(F.sum(F.round(F.col("s") * 1e6).cast("bigint")).alias("total"), F.min("s").alias("near"))
    medoid = sums.groupBy("class_id").agg(F.max_by(F.struct("id", "near"), F.struct("total", -F.col("id"))).alias("m")).select("class_id", F.col("m.id").alias("medoid"), F.col("m.near").alias("medoid_least"))
    n = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_members"))
    modules = classes.join(spread, "id").groupBy("class_id").agg(F.countDistinct("module").alias("modules"))
    rows = rolled.join(n, "class_id").join(medoid, "class_id").join(modules, "class_id").join(prints.select(F.col("id").alias("medoid"), "n_tokens"), "medoid")
    value = F.col("modules") * F.col("n_members") * F.col("n_tokens") * F.col("least")
    r4 = lambda c: F.round(c, 4).alias(c)
    return rows.select("class_id", "n_members", "n_pairs", r4("least"), r4("contained"), "medoid", r4("medoid_least"), r4("fidelity"), confidence(F.col("fidelity"), F.col("least")).alias("confidence"), "modules", F.round(value, 2).alias("roi"))


def coverage_gate(share) -> Column:
    """What a class's return keeps by the share of it that a template covers."""
    return F.when(share < STRONG_GATE, STRONG_KEEPS).when(share < MILD_GATE, MILD_KEEPS).otherwise(1.0)


def dampened(metrics: DataFrame, refined: Column) -> DataFrame:
    """Returns of classes that aren't refined count 1 + ln(1 + members) in place of the members."""
    n = F.col("n_members").cast("double")
    return metrics.withColumn("roi", F.round(F.when(refined | (n <= 0), F.col("roi")).otherwise(F.col("roi") / n * (1 + F.log1p(n))), 2))


def find_clones(metrics: DataFrame, limit: int, coverage: DataFrame | None = None) -> DataFrame:
    """The ``limit`` classes of the highest return, 50 of them refined: those by their gated return, the others by the dampened one.

    ``coverage``: class_id, share (of a class that a template covers; 1 where it isn't known).
    """
    first = metrics.orderBy(F.desc("roi"), "class_id").limit(min(limit, MOST_REFINED)).select("class_id").withColumn("refined", F.lit(True))
    rows = metrics.join(F.broadcast(first), "class_id", "left").withColumn("refined", F.coalesce("refined", F.lit(False)))
    share = F.lit(1.0)
    if coverage is not None:
        rows, share = rows.join(coverage, "class_id", "left"), F.coalesce("share", F.lit(1.0))
    rows = dampened(rows, F.col("refined")).withColumn("roi", F.round(F.when(F.col("refined"), F.col("roi") * coverage_gate(share)).otherwise(F.col("roi")), 2))
    return top_ranked(rows, limit, F.desc("roi"), "class_id").select("class_id", "n_members", "confidence", "refined", "roi", "rank")


def subject_component(pairs: DataFrame, subject: int) -> DataFrame:
    """(id, hops): the members that links reach from one text, and in how many; only the frontier is joined, and each round is cut."""
    both = spill_table(pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")).union(pairs.select("id_b", "id_a")).distinct(), "clone-links")
    seen = both.where(F.col("src") == subject).select(F.col("src").alias("id"), F.lit(0).alias("hops")).limit(1)
    seen, hops = cut(seen), 0
    fresh = seen
    while not fresh.isEmpty():
        hops += 1
        fresh = cut(both.join(fresh.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hops)))
        seen = cut(seen.unionByName(fresh))
    return seen


def clones_of_text(bagged: DataFrame, text: str, language: str, theta: float = THETA) -> DataFrame:
    """(id, overlap, similarity) of the indexed texts (``clones.bags``) that a text is a clone of.

    The text's bag is one row a token and is sent to the workers; a text without enough tokens has no clones.
    """
    theta = check_theta(theta)
    spark = bagged.sparkSession
    own = spark.createDataFrame([(text,)], "text string").select(F.explode(terms("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("mine"))
    n = own.agg(F.coalesce(F.sum("mine"), F.lit(0)).alias("n")).first()["n"]
    if n < clones.LEAST_TOKENS:
        return bagged.select("id", F.lit(0).cast("bigint").alias("overlap"), F.lit(0.0).alias("similarity")).limit(0)
    longest = F.greatest("n_tokens", F.lit(n))
    able = bagged.where((F.col("language") == language) & (F.least("n_tokens", F.lit(n)) >= F.ceil(F.lit(theta) * longest)))
    met = able.join(F.broadcast(own), "token").groupBy("id", "n_tokens").agg(F.sum(F.least("freq", "mine")).alias("overlap"))
    return met.where(F.col("overlap") >= F.ceil(F.lit(theta) * longest)).select("id", "overlap", F.round(F.col("overlap") / longest, 4).alias("similarity"))


def changed_pairs(pairs: DataFrame, bagged: DataFrame, changed: DataFrame, theta: float = THETA) -> DataFrame:
    """The clone pairs after the texts ``changed`` (id) were replaced, added or removed; ``bagged`` holds the bags as they are now.

    Pairs of others stay; pairs of changed texts are found again through their sketches against all, not by pairing all with all.
    """
    ids = changed.select("id").distinct()
    return replaced_pairs(pairs, clone_pairs(bagged, theta, ids), ids)


def replaced_pairs(pairs: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """``pairs`` without those of the texts ``changed`` (id), and their ``fresh`` ones."""
    ids = changed.select("id").distinct()
    kept = pairs.join(ids.withColumnRenamed("id", "id_a"), "id_a", "left_anti").join(ids.withColumnRenamed("id", "id_b"), "id_b", "left_anti")
    return kept.select("id_a", "id_b", "n_a", "n_b", "overlap").unionByName(fresh.select("id_a", "id_b", "n_a", "n_b", "overlap"))


# -- the given documents as texts
def _prints(s: SparkSession, d: str) -> DataFrame:
    return fingerprints(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text"))


def _bags(s, d):
    return spill_table(bags(_prints(s, d)), "clone-bags")


def _prints_and_pairs(s, d):
    prints = clones.stored_prints(s, d)
    return prints, clones.print_pairs(prints)


def _metrics(prints, pairs, s, d):
    return class_metrics(pairs, spill_table(lcs_ratio(pairs, prints), "clone-fidelity"), prints, table(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("module")))


def _find(s, d):
    prints, pairs = _prints_and_pairs(s, d)
    return find_clones(spill_table(_metrics(prints, pairs, s, d), "clone-metrics"), 40, class_templates(clone_classes(pairs), prints).select("class_id", "share"))


def _templates(s, d):
    prints, pairs = _prints_and_pairs(s, d)
    return class_templates(clone_classes(pairs), prints)


def _groups(s, d):
    return coherent_groups(_prints_and_pairs(s, d)[1]).select("class_id", "group_no", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def _delta(s, d):
    """Pairs of the documents of even ids, then changed by those of odd ids: the same as the pairs of all."""
    prints = clones.stored_prints(s, d)
    every = clones.class_marks(prints)
    changed = every.where("id % 3 = 0").select("id")
    old = clones.marked_pairs(every.where("id % 3 <> 0"), prints)
    return replaced_pairs(old, clones.marked_pairs(every, prints, THETA, changed), changed)


def _of_text(s, d):
    text = table(s, d, "documents").where("lang = 'en' and n_chars > 400").orderBy("doc_id").limit(1).first()["text"]
    return clones_of_text(_bags(s, d), text, "en", 0.5)


def _code(s, d):
    texts = table(s, d, "chunk_text").groupBy(F.col("chunk_id").alias("id")).agg(F.max("blob").alias("b")).select("id", F.decode("b", "UTF-8").alias("text"))
    files = table(s, d, "files").groupBy(F.col("id").alias("file_id")).agg(F.min(F.lower(F.trim("language"))).alias("language"))
    return code_fingerprints(table(s, d, "chunks").select("id", "file_id").distinct().join(files, "file_id").join(texts, "id"))


QUERIES = {
    "clone_groups": _groups,
    "clone_metrics": lambda s, d: _metrics(*_prints_and_pairs(s, d), s, d),
    "find_clones": _find,
    "clone_templates": _templates,
    "clone_delta": _delta,
    "clones_of_text": _of_text,
    "code_clone_classes": lambda s, d: clones.exact_classes(_code(s, d)),
}
_X = clones._PAIRS + clones._X
SQL = {
    "clone_delta": f"{_X} SELECT id_a, id_b, n_a, n_b, overlap FROM x",
    "clones_of_text": f"""{clones._PAIRS}, q AS (SELECT token, count(*) AS mine FROM (SELECT unnest(tokens) AS token FROM f WHERE id = (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 400 ORDER BY doc_id LIMIT 1)) GROUP BY 1), n AS (SELECT sum(mine) AS n FROM q)
SELECT id, CAST(sum(least(freq, mine)) AS BIGINT) AS overlap, round(sum(least(freq, mine)) / CAST(greatest(any_value(n_tokens), any_value(n)) AS DOUBLE), 4) AS similarity FROM b JOIN q USING (token), n WHERE language = 'en' GROUP BY id HAVING sum(least(freq, mine)) >= ceil(CAST(0.5 AS DOUBLE) * greatest(any_value(n_tokens), any_value(n)))""",
}

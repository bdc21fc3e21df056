"""Clone detection on token bags: exact classes, candidates by sketches, overlap verification, classes.

A clone pair shares at least ceil(theta * longer length) tokens, repeats counted. Candidates come from ``sketches``, whose bound
loses no pair; prefixes of rare tokens are no use here, since even the rarest tokens of a text are in a tenth of all texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions.exprs import terms
from quernel.operators.graph import connected_components
from quernel.operators.sketches import likely_pairs, numbered, sketched, verified, with_texts
from quernel.plans.cluster import spill_table
from quernel.sources.tables import table

THETA, LEAST_TOKENS = 0.7, 20


def check_theta(theta: float) -> float:
    """A threshold in [0.5, 1]; others, NaN too, are refused."""
    if not 0.5 <= theta <= 1:
        raise ValueError("theta must be between 0.5 and 1")
    return theta


def fingerprints(documents: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """(id, language, struct_hash, n_tokens, tokens) of documents (id, language, text) with at least ``least`` tokens."""
    made = documents.select("id", F.coalesce("language", F.lit("")).alias("language"), terms("text").alias("tokens")).withColumn("n_tokens", F.size("tokens"))
    return made.where(F.col("n_tokens") >= least).withColumn("struct_hash", F.sha2(F.concat_ws("\u0001", "tokens"), 256))


def exact_classes(prints: DataFrame) -> DataFrame:
    """(language, struct_hash, n_members, first_id) of the texts with equal token sequences that occur more than once."""
    return prints.groupBy("language", "struct_hash").agg(F.count(F.lit(1)).alias("n_members"), F.min("id").alias("first_id")).where("n_members > 1")


def bags(prints: DataFrame) -> DataFrame:
    """(id, language, n_tokens, token, freq) of one text per class of equal texts, which its smallest id stands for."""
    own = prints.groupBy("language", "struct_hash").agg(F.min_by(F.struct("id", "n_tokens", "tokens"), F.col("id")).alias("r"))
    return own.select("r.id", "language", "r.n_tokens", F.explode("r.tokens").alias("token")).groupBy("id", "language", "n_tokens", "token").agg(F.count(F.lit(1)).alias("freq"))


def class_marks(prints: DataFrame) -> DataFrame:
    """(id, language, n_tokens, sketch): one text per class of equal texts, which its smallest id stands for; no text is shuffled for it."""
    made = sketched(prints, "struct_hash").groupBy("language", "struct_hash").agg(F.min_by(F.struct("id", "n_tokens", "sketch"), F.col("id")).alias("r"))
    return spill_table(made.select("r.id", "language", "r.n_tokens", "r.sketch"), "clone-marks")


def marked_pairs(marks: DataFrame, texts: DataFrame, theta: float = THETA, changed: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b, n_a, n_b, overlap), id_a < id_b, of one language: the verified pairs of ``marks`` (see ``class_marks``), whose tokens are in ``texts``.

    With ``changed`` (id) only the pairs of which one is changed.
    """
    theta = check_theta(theta)
    marks = marks.where(F.col("id").isNotNull())
    if changed is None:
        marks = marks.withColumn("changed", F.lit(True))
    else:
        own = changed.select("id").distinct().withColumn("changed", F.lit(True))
        marks = spill_table(marks.join(own, "id", "left").withColumn("changed", F.coalesce("changed", F.lit(False))), "clone-marks")
    return spill_table(verified(likely_pairs(marks, theta), texts, theta), "clone-pairs")


def clone_pairs(bagged: DataFrame, theta: float = THETA, changed: DataFrame | None = None) -> DataFrame:
    """The pairs of ``marked_pairs`` from bags (see ``bags``)."""
    theta = check_theta(theta)
    repeated = F.flatten(F.collect_list(F.array_repeat("token", F.col("freq").cast("int"))))
    texts = spill_table(bagged.groupBy("id", "language", "n_tokens").agg(repeated.alias("tokens")), "clone-texts")
    return marked_pairs(spill_table(sketched(texts), "clone-marks"), texts, theta, changed)


def clone_classes(pairs: DataFrame) -> DataFrame:
    """(id, class_id): components of the pairs, named by their smallest id."""
    return connected_components(pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))).select(F.col("node").alias("id"), F.col("component").alias("class_id"))


def class_metrics(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Per class: members, pairs, least and mean similarity (overlap over the longer text)."""
    scored = pairs.select(F.col("id_a").alias("id"), (F.col("overlap") / F.greatest("n_a", "n_b")).alias("s")).join(classes, "id")
    ends = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_members"))
    found = scored.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.min("s"), 4).alias("least_similarity"), F.round(F.avg("s"), 4).alias("mean_similarity"))
    return found.join(ends, "class_id")


def lcs_length(s: list[str], t: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel: a big integer holds a row of the table, so n x m cells cost n x m / 64 word steps."""
    masks: dict[str, int] = {}
    for k, x in enumerate(s):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(s)) - 1
    row = full
    for y in t:
        m = row & masks.get(y, 0)
        row = (row + m | row - m) & full
    return len(s) - row.bit_count()


def lcs_lengths(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``lcs_length`` of every pair of number arrays, a step of all pairs at a time; the tables are rows of 64-bit words with carries between them."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in zip(*pairs, strict=True)]
    most = 1 + max(int(x.max(initial=0)) for pair in pairs for x in pair)
    owner = [np.repeat(np.arange(len(pairs)), n) for n in sizes]
    keys = [np.concatenate(side) + own * most for side, own in zip(zip(*pairs, strict=True), owner, strict=True)]
    place = [np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) for own, n in zip(owner, sizes, strict=True)]
    known, at = np.unique(keys[0], return_inverse=True)
    wide = max(1, -(-int(sizes[0].max(initial=0)) // 64))
    masks = np.zeros((wide, len(known) + 1), np.uint64)  # the last is for tokens that the first text hasn't got
    np.bitwise_or.at(masks, (place[0] // 64, at), np.uint64(1) << (place[0] % 64).astype(np.uint64))
    spot = np.minimum(np.searchsorted(known, keys[1]), max(len(known) - 1, 0))
    asked = np.full((int(sizes[1].max(initial=0)), len(pairs)), len(known))
    asked[place[1], owner[1]] = np.where(known[spot] == keys[1], spot, len(known)) if len(known) else 0
    row = np.full((wide, len(pairs)), ~np.uint64(0))
    for step in asked:
        carry = np.zeros(len(pairs), np.uint64)
        for w in range(wide):
            own = row[w]
            both = own & masks[w][step]
            total = own + both
            over = total < own
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            row[w] = total | (own - both)
    return 64 * wide - np.bitwise_count(row).sum(0, dtype=np.int64)


#: Pairs of texts that are stepped through together, the longest of them; longer ones go through big integers.
LCS_PAIRS, LCS_LONG = 2_048, 768


def lcs_ratio(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """(id_a, id_b, fidelity): longest common subsequence of the tokens over the longer text's, whatever their length.

    What two texts share at both ends is part of some longest subsequence and is cut off first.
    """

    def run(pairs: pd.DataFrame, have: dict) -> pd.DataFrame:
        texts = numbered(have)
        same, longest, rest = np.zeros(len(pairs), np.int64), np.ones(len(pairs), np.int64), []
        for k, (a, b) in enumerate(zip(pairs.id_a.tolist(), pairs.id_b.tolist(), strict=True)):
            s, t = texts[a], texts[b]
            longest[k], short = max(len(s), len(t), 1), min(len(s), len(t))
            other = np.flatnonzero(s[:short] != t[:short])
            low = int(other[0]) if len(other) else short
            s, t = s[low:], t[low:]
            short = min(len(s), len(t))
            other = np.flatnonzero(s[len(s) - short :] != t[len(t) - short :])
            high = short - 1 - int(other[-1]) if len(other) else short
            same[k] = low + high
            rest.append((s[: len(s) - high], t[: len(t) - high]))
        size = np.array([max(len(s), len(t)) for s, t in rest], np.int64)
        order = np.argsort(size, kind="stable")
        few = order[size[order] <= LCS_LONG]
        for x in range(0, len(few), LCS_PAIRS):
            own = few[x : x + LCS_PAIRS]
            same[own] += lcs_lengths([rest[k] for k in own])
        for k in order[len(few) :]:
            same[k] += lcs_length(rest[k][0].tolist(), rest[k][1].tolist())
        return pd.DataFrame({"id_a": pairs.id_a, "id_b": pairs.id_b, "fidelity": [round(x, 4) for x in (same / longest).tolist()]})

    return with_texts(pairs, prints, run, "id_a bigint, id_b bigint, fidelity double")


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "text"))


def stored_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of the documents, written once for queries that read them again."""
    return spill_table(_prints(spark, sf_dir), "clone-prints")


def print_pairs(prints: DataFrame) -> DataFrame:
    return marked_pairs(class_marks(prints), prints)


def q_classes(spark, sf_dir):
    pairs = print_pairs(stored_prints(spark, sf_dir))
    return class_metrics(pairs, clone_classes(pairs))


def q_fidelity(spark, sf_dir):
    prints = stored_prints(spark, sf_dir)
    return lcs_ratio(print_pairs(prints), prints)


QUERIES = {
    "clone_exact": lambda s, d: exact_classes(_prints(s, d)),
    "clone_token_df": lambda s, d: bags(_prints(s, d)).groupBy("language", "token").agg(F.count(F.lit(1)).alias("df")),
    "clone_pairs": lambda s, d: print_pairs(stored_prints(s, d)).select("id_a", "id_b", "n_a", "n_b", "overlap"),
    "clone_classes": q_classes,
    "clone_fidelity": q_fidelity,
}
_F = """WITH f AS (SELECT doc_id AS id, coalesce(lang, '') AS language, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}_-]+'), lambda x: x <> '') AS tokens FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, len(tokens) AS n_tokens, sha256(array_to_string(tokens, chr(1))) AS struct_hash FROM f WHERE len(tokens) >= 20),
r AS (SELECT language, struct_hash, min(id) AS id, any_value(n_tokens) AS n_tokens, any_value(tokens) AS tokens FROM p GROUP BY ALL),
b AS (SELECT id, language, n_tokens, token, count(*) AS freq FROM (SELECT id, language, n_tokens, unnest(tokens) AS token FROM r) GROUP BY ALL)"""
_PAIRS = _F.replace("any_value(tokens) AS tokens FROM p GROUP BY ALL", "any_value(tokens) AS tokens FROM p GROUP BY language, struct_hash").replace("any_value(n_tokens)", "max(n_tokens)")
_X = """, x AS (SELECT a.id AS id_a, b2.id AS id_b, a.n_tokens AS n_a, b2.n_tokens AS n_b, CAST(sum(least(a.freq, b2.freq)) AS BIGINT) AS overlap FROM b a JOIN b b2 ON a.language = b2.language AND a.token = b2.token AND a.id < b2.id GROUP BY ALL
HAVING sum(least(a.freq, b2.freq)) >= ceil(CAST(0.7 AS DOUBLE) * greatest(a.n_tokens, b2.n_tokens)))"""
SQL = {
    "clone_exact": f"{_PAIRS} SELECT language, struct_hash, count(*) AS n_members, min(id) AS first_id FROM p GROUP BY language, struct_hash HAVING count(*) > 1",
    "clone_token_df": f"{_PAIRS} SELECT language, token, count(*) AS df FROM b GROUP BY ALL",
    "clone_pairs": f"{_PAIRS}{_X} SELECT * FROM x",
    "clone_classes": f"""{_PAIRS}{_X}, y AS (SELECT id_a AS src, id_b AS dst FROM x UNION SELECT id_b, id_a FROM x),
c AS (SELECT id, min(class_id) AS class_id FROM (WITH RECURSIVE q(id, class_id) AS (SELECT src, src FROM y UNION SELECT y.dst, q.class_id FROM q JOIN y ON y.src = q.id WHERE q.class_id < y.dst) SELECT * FROM q) GROUP BY id),
m AS (SELECT class_id, count(*) AS n_members FROM c GROUP BY class_id), s AS (SELECT class_id, overlap / CAST(greatest(n_a, n_b) AS DOUBLE) AS s FROM x JOIN c ON id_a = id),
g AS (SELECT class_id, count(*) AS n_pairs, round(min(s), 4) AS least_similarity, round(avg(s), 4) AS mean_similarity FROM s GROUP BY class_id)
SELECT * FROM g JOIN m USING (class_id)""",
}

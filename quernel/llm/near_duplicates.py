"""Near-duplicate records: MinHash LSH forest, then exact verification.

A text is the set of its runs of ``shingle`` consecutive words. Equal sets are one class, named by the set's
64-bit hash, so copies never multiply work. A signature has ``TREES`` labels of full depth, of one
minimum a level; the labels of a tree in sorted order are its prefix trie, and a node is a prefix.

Every class is matched at full depth first and its prefixes are shortened tree by tree, always where that adds
the fewest candidates, until a set at the threshold meets it with probability ``TARGET_RECALL``. In a tree where
the node at the shortest depth that may be needed is small, shortening that far costs next to nothing; only
for classes in larger nodes are the depths chosen one by one (``choose_depths``). Members of the nodes
so reached are candidates; every candidate pair is verified on the whole sets. Large nodes are cut into blocks
whose pairs of blocks run as separate tasks, so no node is capped.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.graph import connected_components
from quernel.plans.cluster import spill_table
from quernel.sources.tables import table

#: For queries that state nothing else: five words, similarity 0.8.
SHINGLE, THRESHOLD, MEMBERS = 5, 0.8, 1
TREES, TARGET_RECALL = 32, 0.999
#: Levels of a tree below the depth that meets the target at the threshold in every tree.
DEEPER = 2
#: Classes of a node that are paired at once; classes of a block of a larger node.
NODE, BLOCK = 64, 512
#: How many standard errors of the sketch's estimate a pair may lie below the threshold and still be verified.
SLACK = 5.0
SEED = 104_729

_WORD = re.compile(rb"[0-9a-z_]+")


def words_of(blob: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and underscores, ASCII-lowercased."""
    return _WORD.findall(blob.lower())


def prefix_depth(threshold: float, trees: int = TREES, target: float = TARGET_RECALL) -> int:
    """The longest prefix at which sets of that similarity meet in some tree with the target probability, 1 at least, 8 at most."""
    depth = 8
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def choose_depths(sizes: list[list[int]], threshold: float, target: float = TARGET_RECALL) -> list[int]:
    """How many levels below the shortest depth a class keeps in each tree whose node there is large.

    ``sizes`` has a row a tree: the sizes of the class's nodes at the shortest depth and each level below.
    All start at full depth; the prefix whose shortening adds the fewest candidates for the miss it saves is
    shortened until a set at the threshold is missed with probability 1 - ``target`` or less. All other trees are
    matched at the shortest depth.
    """
    least = prefix_depth(threshold)
    miss = [math.log1p(-min(threshold ** (least + d), 1 - 1e-12)) for d in range(DEEPER + 1)]
    left = [DEEPER] * len(sizes)
    total = (TREES - len(sizes)) * miss[0] + len(sizes) * miss[DEEPER]
    heap = [((own[DEEPER - 1] - own[DEEPER]) / (miss[DEEPER] - miss[DEEPER - 1]), t) for t, own in enumerate(sizes)]
    heapq.heapify(heap)
    while total > math.log(1 - target) and heap:
        _, t = heapq.heappop(heap)
        d = left[t] = left[t] - 1
        total += miss[d] - miss[d + 1]
        if d:
            heapq.heappush(heap, ((sizes[t][d - 1] - sizes[t][d]) / (miss[d] - miss[d - 1]), t))
    return left


class Signer:
    """Shingle sets and signatures of texts, the same on every worker."""

    def __init__(self, shingle: int, threshold: float):
        rng = np.random.default_rng(SEED)
        self.shingle, self.depth = shingle, prefix_depth(threshold) + DEEPER
        self.mul = rng.integers(1, 2**63, TREES * self.depth, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 2**63, TREES * self.depth, dtype=np.uint64)
        self.step = rng.integers(1, 2**63, shingle, dtype=np.uint64) | np.uint64(1)
        self.known: dict[bytes, int] = {}

    def shingles(self, blob: bytes) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes."""
        import xxhash

        words = words_of(blob)
        n = len(words) - self.shingle + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        if len(self.known) > 1_000_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w, SEED)
        ids = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        x = np.zeros(n, np.uint64)
        for k in range(self.shingle):
            x = (x ^ (x >> np.uint64(32))) * self.step[k] + ids[k : k + n]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return np.unique(x)

    def minima(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """sets x (TREES * depth) minima of the concatenated sets that begin at ``starts``."""
        out = np.empty((len(starts), len(self.mul)), np.uint32)
        for i in range(len(self.mul)):
            out[:, i] = np.minimum.reduceat((values * self.mul[i] + self.add[i]) >> np.uint64(32), starts)
        return out


def class_of(shingles: np.ndarray) -> int:
    """The class of a set: a 64-bit hash of its sorted shingles."""
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED) - 2**63


@dataclass(frozen=True)
class Forest:
    """Signatures (id, class, members, sketch) of ``texts`` (id, blob), and what they were made with."""

    signatures: DataFrame
    texts: DataFrame
    shingle: int
    threshold: float


#: ``sketch``: TREES labels of full depth, 16 bits a minimum.
SIGNED = "id bigint, class bigint, members int, sketch binary"


def signed(texts: DataFrame, shingle: int, threshold: float, members: int) -> DataFrame:
    """Signature rows of ``texts`` (id bigint, blob binary) with at least ``members`` distinct shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(shingle, threshold)
        for b in batches:
            for at in range(0, len(b), 512):
                ids, sets = [], []
                for i, blob in zip(b.id[at : at + 512], b.blob[at : at + 512], strict=True):
                    s = signer.shingles(bytes(blob))
                    if len(s) >= max(members, 1):
                        ids.append(i)
                        sets.append(s)
                if not ids:
                    continue
                starts = np.cumsum([0, *map(len, sets)])[:-1]
                minima = signer.minima(np.concatenate(sets), starts)
                sketch = minima.astype(np.uint16)
                yield pd.DataFrame(
                    {
                        "id": ids,
                        "class": [class_of(s) for s in sets],
                        "members": [len(s) for s in sets],
                        "sketch": [x.tobytes() for x in sketch],
                    }
                )

    ready = texts.where(F.col("id").isNotNull() & (F.octet_length("blob") >= 2 * (shingle + max(members, 1)) - 3)).select("id", "blob")
    return ready.mapInPandas(run, SIGNED)


def least_agreement(threshold: float, minima: int) -> float:
    """Share of equal minima below which a pair is at least ``SLACK`` standard errors under the threshold."""
    return threshold - SLACK * (threshold * (1 - threshold) / minima) ** 0.5


def _keyed(signatures: DataFrame, threshold: float) -> DataFrame:
    """(class, key): the node of each class at the shortest depth, in every tree; the last five bits are the tree."""
    least = prefix_depth(threshold)
    width = 2 * (least + DEEPER)
    rows = signatures.select("class", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    prefix = F.expr(f"substring(sketch, {width} * tree + 1, {2 * least})")
    return rows.select("class", F.xxhash64(prefix, "tree").bitwiseAND(F.lit(-TREES)).bitwiseOR(F.col("tree").cast("bigint")).alias("key"))


def _chosen(members: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """(class, node, depth, n, asks): the nodes of large nodes' members, from the shortest depth (0) down, their sizes, and whether the class is matched there.

    A node of one class is left out.
    """
    least = prefix_depth(threshold)
    width = 2 * (least + DEEPER)
    rows = members.join(sketches.select("class", "sketch"), "class")
    rows = rows.select("class", "key", "n", F.expr(f"substring(sketch, cast({width} * (key & {TREES - 1}) + {2 * least} + 1 as int), {2 * DEEPER})").alias("rest"))
    rows = rows.withColumn("node0", F.col("key"))
    for d in range(1, DEEPER + 1):
        rows = rows.withColumn(f"node{d}", F.xxhash64("key", F.expr(f"substring(rest, 1, {2 * d})")))
    rows = spill_table(rows.drop("rest", "n"), "large-nodes")
    for d in range(DEEPER + 1):
        rows = rows.join(rows.groupBy(f"node{d}").agg(F.count(F.lit(1)).alias(f"n{d}")), f"node{d}")
    nodes = F.struct(*[F.col(f"{x}{d}") for d in range(DEEPER + 1) for x in ("node", "n")])
    own = rows.groupBy("class").agg(F.collect_list(nodes).alias("trees"))  # TREES at most

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, trees in zip(b["class"], b.trees, strict=True):
                left = choose_depths([[t[f"n{d}"] for d in range(DEEPER + 1)] for t in trees], threshold)
                out += [(c, t[f"node{d}"], d, t[f"n{d}"], d == at) for t, at in zip(trees, left, strict=True) for d in range(DEEPER + 1) if t[f"n{d}"] > 1]
            yield pd.DataFrame(out, columns=["class", "node", "depth", "n", "asks"]).astype({"class": "int64", "node": "int64", "depth": "int32", "n": "int64", "asks": "bool"})

    return own.mapInPandas(choose, "class bigint, node bigint, depth int, n bigint, asks boolean")


def _hot_pairs(members: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a class and the members of its large nodes at the depths chosen for it, block against block, that size and sketch allow."""
    rows = spill_table(_chosen(members, sketches, threshold), "chosen-depths")
    blocks = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = blocks.where("asks").withColumn("i", spread).select("node", "i", F.col("block").alias("j"), F.lit(True).alias("asks"), "class")
    asked = rows.where("asks").select("node").distinct()
    index = blocks.join(asked, "node", "left_semi").withColumn("j", spread).select("node", F.col("block").alias("i"), "j", F.lit(False).alias("asks"), "class")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        left, right = own[own.asks], own[~own.asks]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        s, t = (np.frombuffer(b"".join(map(bytes, x.sketch)), np.uint16).reshape(len(x), -1) for x in (left, right))
        n, m = left.members.to_numpy(), right.members.to_numpy()
        like = np.zeros((len(s), len(t)), np.uint16)
        for c in range(s.shape[1]):
            like += s[:, c, None] == t[None, :, c]
        small, large = np.minimum(n[:, None], m[None]), np.maximum(n[:, None], m[None])
        x, y = np.nonzero((like >= least_agreement(threshold, s.shape[1]) * s.shape[1]) & (small >= threshold * large - 1e-9))
        a, b = left["class"].to_numpy()[x], right["class"].to_numpy()[y]
        keep = a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}).drop_duplicates()

    return asking.unionByName(index).join(sketches, "class").groupBy("node", "i", "j").applyInPandas(run, "a bigint, b bigint")


def _sets(forest: Forest, classes: DataFrame) -> DataFrame:
    """(class, shingles) of the given classes, made again from one text of each."""
    ids = forest.signatures.select("class", "id").join(classes, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id")).select("id")
    texts = forest.texts.select("id", "blob").join(ids, "id", "left_semi")
    shingle, threshold = forest.shingle, forest.threshold

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(shingle, threshold)
        for b in batches:
            sets = [signer.shingles(bytes(x)) for x in b.blob]
            yield pd.DataFrame({"class": [class_of(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    return texts.where("blob is not null").mapInPandas(run, "class bigint, shingles binary").groupBy("class").agg(F.first("shingles").alias("shingles"))


def _agree(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            s, t = (np.frombuffer(b"".join(map(bytes, x)), np.uint16).reshape(len(b), -1) for x in (b.s, b.t))
            b = b[(s == t).mean(1) >= least_agreement(threshold, s.shape[1])]
        yield b[["a", "b"]]


def similar_classes(forest: Forest) -> DataFrame:
    """(a, b, similarity): verified pairs a < b of classes."""
    threshold = forest.threshold
    keyed = _keyed(forest.signatures, threshold)
    shared = keyed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
    members = spill_table(keyed.join(shared, "key").distinct(), "node-members")
    sketches = forest.signatures.select("class", "members", "sketch").join(members.select("class").distinct(), "class", "left_semi")
    sketches = spill_table(sketches.groupBy("class").agg(F.first("members").alias("members"), F.first("sketch").alias("sketch")), "sketches")
    later = F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    few = members.where(F.col("n") <= NODE).groupBy("key").agg(F.sort_array(F.collect_set("class")).alias("own"))
    pairs = few.select(F.explode(F.flatten(later)).alias("p")).select("p.a", "p.b")
    hot = members.where(F.col("n") > NODE)
    if not hot.isEmpty():
        pairs = pairs.unionByName(_hot_pairs(hot, sketches, threshold))
    sizes = sketches.select("class", "members")
    sized = pairs.distinct().join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b")
    sized = sized.where(F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m") - 1e-9).select("a", "b")
    drawn = sketches.select("class", "sketch")
    likely = sized.join(drawn.toDF("a", "s"), "a").join(drawn.toDF("b", "t"), "b").mapInPandas(lambda it: _agree(it, threshold), "a bigint, b bigint")
    pairs = spill_table(likely, "candidates")
    sets = spill_table(_sets(forest, pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()), "candidate-sets")
    both = pairs.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s, t in zip(batch.s, batch.t, strict=True):
                x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[place] == x).sum())
                out.append(common / (len(x) + len(y) - common))
            batch = batch.assign(similarity=out)[["a", "b", "similarity"]]
            yield batch[batch.similarity >= threshold - 1e-12]

    return both.mapInPandas(verify, "a bigint, b bigint, similarity double")


def near_duplicate_forest(texts: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, members: int = MEMBERS) -> Forest:
    """The signatures that the other functions take.

    ``texts``: id bigint, blob binary (UTF-8); other columns are ignored. Null ids, null blobs and texts with
    fewer than ``members`` distinct shingles take no part; repeated rows count once; an id with several
    texts takes part with each of them.
    """
    if not 0 < threshold <= 1 or shingle < 1:
        raise ValueError("threshold must be in (0, 1] and shingle positive")
    texts = texts.select("id", "blob")
    return Forest(spill_table(signed(texts, shingle, threshold, members), "signatures"), texts, shingle, threshold)


def near_duplicate_groups(forest: Forest) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per document.

    class_id: smallest id with an equal set; group_id: smallest id of the classes joined by links; n_links:
    links of the document's class to other classes.
    """
    links = spill_table(similar_classes(forest), "links")
    ids = forest.signatures.select("class", "id").distinct()
    both = links.select("a", "b").union(links.select("b", "a"))
    count = both.groupBy(F.col("a").alias("class")).agg(F.count(F.lit(1)).alias("n_links"))
    parts = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "class")
    first = ids.groupBy("class").agg(F.min("id").alias("class_id"))
    named = first.join(parts, "class", "left").join(count, "class", "left").withColumn("component", F.coalesce("component", "class"))
    group = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return ids.join(named.join(group, "component"), "class").select("id", "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicate_pairs(forest: Forest) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of documents, copies expanded."""
    links = similar_classes(forest).select("a", "b")
    ids = spill_table(forest.signatures.select("class", "id").distinct(), "class-members")
    many = ids.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b"))
    left, right = ids.toDF("a", "i"), ids.toDF("b", "j")
    pairs = links.join(left, "a").join(right, "b").select("i", "j").union(many.join(left, "a").join(right, "b").where("i < j").select("i", "j"))
    return pairs.where("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


#: As TESTDATA.md states the problem.
CHUNK_SHINGLE, CHUNK_THRESHOLD, CHUNK_MEMBERS = 3, 0.6, 20


def chunk_forest(spark: SparkSession, sf_dir: str) -> Forest:
    texts = table(spark, sf_dir, "chunk_text").select(F.col("chunk_id").alias("id"), "blob")
    return near_duplicate_forest(texts, CHUNK_SHINGLE, CHUNK_THRESHOLD, CHUNK_MEMBERS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose sets of three words agree to 60 % or more."""
    pairs = near_duplicate_pairs(chunk_forest(spark, sf_dir))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-equal chunks: one row per chunk."""
    return near_duplicate_groups(chunk_forest(spark, sf_dir)).withColumnRenamed("id", "chunk_id")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
_WORDS_SQL = """
WITH t AS (SELECT DISTINCT chunk_id, regexp_extract_all(translate(decode(blob), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z_]+') AS w FROM chunk_text),
s AS (SELECT DISTINCT chunk_id, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS k FROM t)),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id HAVING count(*) >= 20),
b AS (SELECT s.chunk_id, s.g, n.n FROM s JOIN n USING (chunk_id)),
x AS (SELECT p.chunk_id AS chunk_id_a, q.chunk_id AS chunk_id_b, p.n AS na, q.n AS nb, count(*) AS c FROM b p JOIN b q ON p.g = q.g AND p.chunk_id < q.chunk_id GROUP BY ALL)
SELECT chunk_id_a, chunk_id_b FROM x WHERE 10 * c >= 6 * (na + nb - c)
"""
SQL = {"p4_found": _WORDS_SQL}

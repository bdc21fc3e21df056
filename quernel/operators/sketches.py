"""Pairs of token bags that can overlap enough, by parity sketches that are compared block by block.

A bag's occurrences are (token, how often it came before). A sketch has one bit for each hash bucket: the parity of the
occurrences in it. Two sketches differ in at most as many bits as there are occurrences that only one of the bags has, so a pair
whose sketches differ in more than an overlap of ceil(theta * longer length) leaves over is no clone, and no clone is lost.
Sketches have 4 to 8 bits a token; halves are folded on each other for a first pass by products of matrices of signs.

Bags are cut by language and length into blocks, and only blocks whose lengths can match meet, in a task of their own. No pair
is shuffled before it has passed; the comparisons in the tasks still grow with the square of the bags of about one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.plans.cluster import broadcast_if_small, spill_table

#: Bits of a sketch: at least, at most; bytes that a bag counts beside its sketch.
LEAST_BITS, MOST_BITS, BAG_BYTES = 128, 65_536, 64
#: Blocks that all bags are cut into, and the bytes of a block, at least and at most.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 12, 1 << 18, 16 << 20
#: Cells of a matrix of signs; pairs of which the whole sketches are compared at a time.
TILE, CHUNK = 1 << 19, 1 << 15
#: Tokens of texts that a part of the pairs reads, a pair counted as some for each 256 of its length; numbers that ids are spread by; rows that are looked up by a broadcast.
PART_TOKENS, PAIR_TOKENS, SPREAD, MOST_SENT = 2_000_000, 10, 1_024, 500_000


def sketch(hashes: list[np.ndarray]) -> list[bytes]:
    """The sketch of each bag, given as the hashes of its tokens, repeats kept."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    bits = np.array([min(max(LEAST_BITS, 1 << int(4 * n - 1).bit_length()), MOST_BITS) if n else LEAST_BITS for n in sizes], np.int64)
    ends = np.cumsum(bits)
    if not len(sizes):
        return []
    token, owner = np.concatenate([np.asarray(h, np.int64) for h in hashes]), np.repeat(np.arange(len(sizes)), sizes)
    token = token[np.lexsort((token, owner))].view(np.uint64)
    at = np.arange(len(token))
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    before = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    mixed = (token + before * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    cell = (mixed & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(cell + (ends - bits)[owner], minlength=int(ends[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[(e - b) // 8 : e // 8] for e, b in zip(ends.tolist(), bits.tolist(), strict=True)]


def sketched(texts: DataFrame, *keep: str) -> DataFrame:
    """(id, language, n_tokens, ``keep``, sketch) of texts (id, language, n_tokens, tokens)."""
    columns = ["id", "language", "n_tokens", *keep]
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[columns].assign(sketch=sketch(list(b.hashes)))

    rows = texts.select(*columns, F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sketch binary")


def fold(words: np.ndarray) -> np.ndarray:
    """Sketches of half as many bits of the same bags."""
    half = words.shape[1] // 2
    return words[:, :half] ^ words[:, half:]


class Bags:
    """Bags of a block in the order of length and id: their sketches by number of words."""

    def __init__(self, rows: pd.DataFrame, theta: float):
        rows = rows.sort_values(["n_tokens", "id"], kind="stable")
        self.ids, self.n, self.place = rows.id.to_numpy(np.int64), rows.n_tokens.to_numpy(np.int64), np.arange(len(rows))
        self.changed = rows.changed.to_numpy(bool)
        self.need = np.ceil(theta * self.n).astype(np.int64)
        wide, self.sketches = rows.sketch.map(len).to_numpy() // 8, {}
        for w in np.unique(wide):
            own = np.flatnonzero(wide == w)
            self.sketches[int(w)] = own, np.frombuffer(b"".join(map(bytes, rows.sketch.to_numpy()[own])), "<u8").reshape(len(own), w)

    def of(self, wide: int, some: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        own, words = self.sketches.get(wide, (np.zeros(0, np.int64), np.zeros((0, wide), np.uint64)))
        if some is None:
            return own, words
        return own[some[own]], words[some[own]]


def _signs(words: np.ndarray, *more: np.ndarray) -> np.ndarray:
    bits = 64 * words.shape[1]
    out = np.empty((len(words), bits + len(more)), np.float32)
    out[:, :bits] = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    out[:, :bits] *= 2
    out[:, :bits] -= 1
    for k, x in enumerate(more):
        out[:, bits + k] = x
    return out


def close(a: Bags, b: Bags, some_a: np.ndarray | None = None, some_b: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of pairs that the sketches leave as possible clones; no bag of ``a`` is longer than those of ``b``, or both are one block."""
    for wide in sorted(a.sketches):
        rows, left = a.of(wide, some_a)
        for other in (wide, 2 * wide):  # a longer bag that may match has at most twice the bits
            columns, right = b.of(other, some_b)
            if not len(rows) or not len(columns):
                continue
            if other > wide:
                right = fold(right)
            yield from _close(a, b, rows, left, columns, right)


def _close(a: Bags, b: Bags, rows: np.ndarray, left: np.ndarray, columns: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    few_left, few_right, bits = fold(left), fold(right), 32 * left.shape[1]
    step = max(16, min(1024, TILE // bits))
    for x in range(0, len(rows), step):
        own = rows[x : x + step]
        first = np.searchsorted(columns, own[0], "right") if a is b else np.searchsorted(b.n[columns], a.n[own[0]])
        last = np.searchsorted(b.need[columns], a.n[own[-1]], "right")
        # signs . signs = bits - 2 * differing, and differing <= n_a + n_b - 2 * need: one product with two more columns tells by its sign
        signs = _signs(few_left[x : x + step], 2.0 * a.n[own], np.ones(len(own)))
        for y in range(first, last, 4 * step):
            cut = slice(y, min(y + 4 * step, last))
            theirs = columns[cut]
            found = np.flatnonzero(signs @ _signs(few_right[cut], np.ones(len(theirs)), 2.0 * b.n[theirs] - 4.0 * b.need[theirs] - bits).T > -0.5)
            for z in range(0, len(found), CHUNK):
                r, c = np.divmod(found[z : z + CHUNK], len(theirs))
                p, q = own[r], theirs[c]
                left_over = a.n[p] + b.n[q] - 2 * b.need[q]
                good = (a.n[p] >= b.need[q]) & (np.bitwise_count(left[x + r] ^ right[y + c]).sum(1, dtype=np.int64) <= left_over)
                if a is b:
                    good &= p < q
                yield p[good], q[good]


PAIRS = "id_a bigint, id_b bigint, n_a int, n_b int"


def likely_pairs(marks: DataFrame, theta: float) -> DataFrame:
    """(id_a, id_b, n_a, n_b), id_a < id_b, of one language: every pair that may overlap by theta, and few others.

    ``marks``: id, language, n_tokens, sketch, changed (only pairs come out of which one is changed). It is read several times.
    """
    spark = marks.sparkSession
    sizes = marks.groupBy("language", "n_tokens").agg(F.count(F.lit(1)).alias("_same"), (F.max(F.octet_length("sketch")) + BAG_BYTES).alias("_bytes"))
    sizes = spill_table(sizes, "bag-sizes")
    total = sizes.agg(F.coalesce(F.sum(F.col("_same") * F.col("_bytes")), F.lit(0)).alias("n")).first()["n"]
    size = min(max(total // BLOCKS, LEAST_BLOCK), MOST_BLOCK)
    before = F.coalesce(F.sum(F.col("_same") * F.col("_bytes")).over(Window.partitionBy("language").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # equal lengths are spread over their part of the order by a hash
    at = F.col("_before") + F.pmod(F.xxhash64("id"), F.col("_same")) * F.col("_bytes")
    blocks = marks.join(sizes.withColumn("_before", before), ["language", "n_tokens"]).withColumn("block", F.floor(at / size).cast("int"))
    blocks = blocks.select("id", "language", "n_tokens", "sketch", "changed", "block")
    ranges: dict[str, list] = {}
    for r in blocks.groupBy("language", "block").agg(F.min("n_tokens").alias("lo"), F.max("n_tokens").alias("hi")).collect():
        ranges.setdefault(r.language, []).append((r.block, r.lo, r.hi))
    meet = []
    for language, own in ranges.items():
        own.sort()
        for k, (i, _, hi) in enumerate(own):
            meet += [(language, i, j, len(meet) + n) for n, (j, lo, _) in enumerate(x for x in own[k:] if np.ceil(theta * x[1]) <= hi)]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 12, len(meet)))
    meet = spark.createDataFrame(meet, "language string, i int, j int, task int")
    rows = lambda side, of: blocks.join(of.withColumnRenamed(side, "block"), ["language", "block"]).select("task", "id", "n_tokens", "sketch", "changed").toDF(*(f"{side}_{c}" for c in ("task", "id", "n_tokens", "sketch", "changed")))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = (x.rename(columns=lambda c: c[2:]) for x in (left, right))
        a = Bags(left, theta)
        b = Bags(right, theta) if len(right) else a
        # a pair needs a changed bag: changed ones on the left with all, the others with changed ones
        turns = [(None, None)] if a.changed.all() else [(a.changed, None), (~a.changed, b.changed)]
        found = [pd.DataFrame({"x": a.ids[p], "y": b.ids[q], "m": a.n[p], "n": b.n[q]}) for t in turns for p, q in close(a, b, *t)]
        if not found:
            return pd.DataFrame({"id_a": [], "id_b": [], "n_a": [], "n_b": []}, dtype="int64")
        f = pd.concat(found)
        turn = (f.x > f.y).to_numpy()
        pick = lambda s, t: np.where(turn, f[t], f[s])
        return pd.DataFrame({"id_a": pick("x", "y"), "id_b": pick("y", "x"), "n_a": pick("m", "n"), "n_b": pick("n", "m")})

    left, right = rows("i", meet.drop("j")), rows("j", meet.where("i < j").drop("i"))
    found = left.repartition(tasks, "i_task").groupBy("i_task").cogroup(right.repartition(tasks, "j_task").groupBy("j_task")).applyInPandas(search, PAIRS)
    return spill_table(found, "clone-likely")


def with_texts(pairs: DataFrame, texts: DataFrame, run, schema: str) -> DataFrame:
    """``run``(pairs, tokens by id) over the pairs (id_a, id_b, n_a, n_b, ...) in parts of about ``PART_TOKENS``; a text goes once to every part that asks for it.

    Texts are put together by length, since clones have about the same; equal lengths are spread by a hash. Without n_a and n_b all count as equal.
    ``pairs`` is read several times. A pair of which a text is missing is left out.
    """
    long = lambda x: F.col(f"n_{x}").cast("bigint") if f"n_{x}" in pairs.columns else F.lit(1).cast("bigint")
    ends = pairs.select(F.col("id_a").alias("id"), long("a").alias("n")).union(pairs.select("id_b", long("b")))
    sizes = spill_table(ends.groupBy("n").agg((F.count_distinct("id") * F.col("n") + F.count(F.lit(1)) * PAIR_TOKENS * (1 + F.floor(F.col("n") / 256))).alias("w")), "text-sizes")
    before = F.coalesce(F.sum("w").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a length
    sizes = broadcast_if_small(sizes.withColumn("before", before), MOST_SENT)

    def placed(rows: DataFrame, x: str) -> DataFrame:
        at = F.floor((F.col("before") + F.col("w") * F.pmod(F.xxhash64(f"id_{x}"), F.lit(SPREAD)) / SPREAD) / PART_TOKENS).cast("int")
        return rows.withColumn("n", long(x)).join(sizes, "n").withColumn(f"_{x}", at).drop("n", "w", "before")

    keyed = placed(placed(pairs, "a"), "b")
    asked = spill_table(keyed.select("_a", "_b", F.col("id_a").alias("id")).union(keyed.select("_a", "_b", "id_b")).distinct(), "texts-asked")
    parts = asked.select("_a", "_b").distinct().count()
    own = texts.select("id", "tokens").join(broadcast_if_small(asked, MOST_SENT), "id").select(F.col("_a").alias("_x"), F.col("_b").alias("_y"), "id", "tokens")

    def part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        have = dict(zip(right.id.tolist(), right.tokens, strict=True))
        return run(left[left.id_a.isin(have) & left.id_b.isin(have)].drop(columns=["_a", "_b"]), have)

    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(parts, 1 << 12))
    return keyed.repartition(tasks, "_a", "_b").groupBy("_a", "_b").cogroup(own.repartition(tasks, "_x", "_y").groupBy("_x", "_y")).applyInPandas(part, schema)


def numbered(texts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The tokens of each text as numbers."""
    if not texts:
        return {}
    code = pd.factorize(np.concatenate([np.asarray(t, object) for t in texts.values()]))[0].astype(np.int64)
    return dict(zip(texts, np.split(code, np.cumsum([len(t) for t in texts.values()])[:-1]), strict=True))


def occurrences(texts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Each text's bag as the numbers (from 0) of its occurrences; equal ones have equal numbers."""
    if not texts:
        return {}
    sizes = np.array([len(t) for t in texts.values()], np.int64)
    code = np.concatenate(list(numbered(texts).values()))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    code = code[np.lexsort((code, owner))]
    at = np.arange(len(code))
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    before = at - np.maximum.accumulate(np.where(fresh, at, 0))
    number = np.unique(code * (int(before.max(initial=0)) + 1) + before, return_inverse=True)[1]
    return dict(zip(texts, np.split(number, np.cumsum(sizes)[:-1]), strict=True))


def overlaps(pairs: pd.DataFrame, bags: dict[int, np.ndarray]) -> np.ndarray:
    """How many numbers the bags of each pair (id_a, id_b) share; the bags of one ``id_a`` are counted together."""
    out = np.zeros(len(pairs), np.int64)
    mark = np.zeros(1 + max((int(b.max(initial=0)) for b in bags.values()), default=0), bool)
    others = pairs.id_b.to_numpy()
    for a, rows in pairs.reset_index(drop=True).groupby("id_a").indices.items():
        mark[bags[a]] = True
        theirs = [bags[b] for b in others[rows].tolist()]
        ends = np.cumsum([len(b) for b in theirs])
        total = np.concatenate([[0], np.cumsum(mark[np.concatenate(theirs)])])
        out[rows] = np.diff(total[np.concatenate([[0], ends])])
        mark[bags[a]] = False
    return out


def verified(pairs: DataFrame, texts: DataFrame, theta: float) -> DataFrame:
    """(id_a, id_b, n_a, n_b, overlap) of the pairs whose bags share ceil(theta * longer length) occurrences, counted on the tokens."""

    def run(pairs: pd.DataFrame, have: dict) -> pd.DataFrame:
        out = pairs[["id_a", "id_b", "n_a", "n_b"]].assign(overlap=overlaps(pairs, occurrences(have)))
        return out[out.overlap >= np.ceil(theta * np.maximum(out.n_a, out.n_b))]

    return with_texts(pairs, texts, run, PAIRS + ", overlap bigint")

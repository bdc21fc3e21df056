"""Filling containers of fixed capacity with texts.

Texts are measured in tokens of a public tokenizer. The global histogram of lengths (at most ``capacity``
entries, whatever the collection) goes to the driver, where dynamic programming chooses the bucket
boundaries that minimise padding and batches are planned inside each bucket: containers of the longest
items left, filled up to the token budget with items of the same bucket, then of shorter buckets. A plan is
a list of patterns with a multiplicity, so its size too is bounded by the capacity. The rows then look up
their container by (length, rank among equals); ranks come from counts per (length, shard), so a length
that a third of all items has is spread over shards.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.plans.cluster import spill_table
from quernel.sources.tables import table

CAPACITY, BUCKETS = 2_048, 16
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of that vocabulary (a fixed value of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of one length in one shard, on average.
SHARD_ROWS = 50_000
#: Characters that are encoded at once; a longer text is cut at the next place after so many where the pattern always ends a match.
ENCODE_CHARS = 100_000
_ENDS = re.compile(r"[!-~](?=[ \n])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[A-Za-z0-9](?=[!-/:-@\[-`{-~])")


@cache
def encoder(vocabulary: bytes):
    """The encoder of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("measured", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, vocabulary: bytes) -> int:
    """Tokens of a text, as the encoder counts them for the whole text."""
    code, n, at = encoder(vocabulary), 0, 0
    while len(text) - at > ENCODE_CHARS:
        end = _ENDS.search(text, at + ENCODE_CHARS)
        cut = end.end() if end else len(text)
        n += len(code.encode_ordinary(text[at:cut]))
        at = cut
    return n + len(code.encode_ordinary(text[at:]))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row; null for a null text. The vocabulary (a path of the driver) is sent to the workers."""
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "n_tokens": pd.array([None if t is None else count_tokens(t, sent.value) for t in b.text], "Int64")})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_tokens bigint")


def bucket_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the padding of all items to their bound (exact)."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    count = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in sizes])]).astype(np.float64)
    total = np.concatenate([[0], np.cumsum([histogram[int(x)] * int(x) for x in sizes])]).astype(np.float64)
    n, k = len(sizes), min(buckets, len(sizes))
    best, back = np.full(n + 1, np.inf), np.zeros((k + 1, n + 1), np.int64)
    best[0] = 0
    for b in range(1, k + 1):
        now = np.full(n + 1, np.inf)
        for j in range(1, n + 1):
            cost = best[:j] + sizes[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            i = int(cost.argmin())
            now[j], back[b, j] = cost[i], i
        best = now
    bounds, j = [], n
    for b in range(k, 0, -1):
        if j == 0:
            break
        bounds.append(int(sizes[j - 1]))
        j = int(back[b, j])
    return bounds[::-1]


def plan_batches(histogram: dict[int, int], capacity: int, buckets: int = BUCKETS) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length its runs (first rank, items, items a container, first container), and the number of containers.

    A container starts with the longest length left, takes as many items of its bucket as fit, longest first,
    then fills up from shorter buckets. A pattern repeats as often as the counts allow.
    """
    bounds = bucket_bounds(histogram, buckets)
    left = {x: n for x, n in histogram.items() if n}
    lengths = np.array(sorted(left, reverse=True), np.int64)
    alive = np.ones(len(lengths), bool)
    used = dict.fromkeys(left, 0)
    floor_of = np.array([max([0, *(b for b in bounds if b < x)]) for x in lengths.tolist()], np.int64)
    runs: dict[int, list] = {x: [] for x in left}
    containers = 0
    while alive.any():
        first = int(alive.argmax())
        pattern, room = {}, capacity
        for same in (True, False):
            k = first
            while k < len(lengths):
                fits = alive[k:] & (lengths[k:] <= room)
                fits &= (lengths[k:] > floor_of[first]) if same else (lengths[k:] <= floor_of[first])
                if not fits.any():
                    break
                k += int(fits.argmax())
                x = int(lengths[k])
                n = min(room // x, left[x] - pattern.get(x, 0))
                if n:
                    pattern[x] = pattern.get(x, 0) + n
                    room -= n * x
                k += 1
        times = min(left[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            runs[x].append((used[x], n * times, n, containers))
            used[x] += n * times
            left[x] -= n * times
            if not left[x]:
                alive[int(np.searchsorted(-lengths, -x))] = False
        containers += times
    return runs, containers


PLACED = "doc_id bigint, piece bigint, start_token bigint, n_tokens bigint, container bigint"


def pack(counts: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, container) of ``counts`` (doc_id, n_tokens); other columns are ignored.

    An item over ``capacity`` becomes full containers of its own and a rest that is packed like an item; no
    other item is split. Null or zero lengths have container null; repeated rows are items of their own;
    a null doc_id is packed too.
    """
    if capacity < 1 or buckets < 1:
        raise ValueError("capacity and buckets must be positive")
    spark = counts.sparkSession
    items = counts.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"))
    pieces = F.when(F.col("n") > 0, F.ceil(F.col("n") / capacity) - 1).otherwise(0)
    split = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces.cast("bigint"))))
    split = split.select("doc_id", "piece", (F.col("piece") * capacity).alias("start_token"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("n_tokens"))
    split = spill_table(split.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r.n_tokens: r.n for r in split.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan_batches(histogram, capacity, buckets)
    shards = max(1, -(-max(histogram.values(), default=1) // SHARD_ROWS))
    split = split.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    sizes = split.groupBy("n_tokens", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("n_tokens").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("n_tokens", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = Window.partitionBy("n_tokens", "_shard").orderBy("_row")
    ranked = split.withColumn("_rank", F.row_number().over(place) - 1).join(sizes, ["n_tokens", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_offset"))
    sent = spark.sparkContext.broadcast({x: np.array(r, np.int64) for x, r in runs.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.array([None] * len(b), "Int64")
            for x, own in b.reset_index(drop=True).groupby("n_tokens"):
                plan = sent.value.get(x)
                if plan is not None:
                    rank = own["_rank"].to_numpy()
                    k = np.searchsorted(plan[:, 0], rank, "right") - 1
                    out[own.index.to_numpy()] = plan[k, 3] + (rank - plan[k, 0]) // plan[k, 2]
            yield b.assign(container=out)[["doc_id", "piece", "start_token", "n_tokens", "container"]]

    return ranked.select("doc_id", "piece", "start_token", "n_tokens", "_rank").mapInPandas(run, PLACED)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of its pieces if it alone exceeds the capacity."""
    return pack(spill_table(token_counts(table(spark, sf_dir, "documents")), "token-counts"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, unused room and the least number of containers that the tokens need."""
    used = p7_containers(spark, sf_dir).where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return used.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"), (F.count(F.lit(1)) * CAPACITY - F.sum("n")).alias("unused"),
        F.ceil(F.sum("n") / CAPACITY).alias("least_containers"),
    )


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL: dict[str, str] = {}

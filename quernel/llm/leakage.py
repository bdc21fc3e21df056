"""Evaluation passages leaking into documents.

Both sides are cut into windows of ``words`` consecutive words. A seeded CGK random walk maps a
window to a string whose Hamming distance tracks the windows' edit distance: at step j the walk writes
the word it stands on and moves on by one with a random bit of (j, word), so that walks of similar
windows meet again after an edit. Repeated bit sampling (samples of ``SAMPLED`` steps) makes the
keys of a locality-sensitive index of the item windows; a document window that shares a key with an
item window is a candidate. Equal windows share all keys, so a verbatim passage is never lost; of passages
of the size of an item with edits as many are met as ``RECALL`` asks: the number of samples follows from it
(``tables_for``). Windows have the size that a passage must share, since that may be shorter than the item. Candidates are then
verified on words: the longest common run around the hit, and the edit distance of the passage.

Documents never shuffle: their rows stream past the index of one block of items (``BLOCK_WORDS`` bounds
what is sent to the workers; more items mean more blocks, each against all documents).
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.plans.cluster import spill_table
from quernel.sources.tables import table

#: Words that a passage must share with an item.
WORDS = 12
#: Steps of the random walk for each word of a window (a step moves on by half a word on average, so that later steps would only
#: write pads), steps sampled for a key, most keys of a window.
WALK, SAMPLED, MOST_TABLES = 2, 6, 24
#: Share of the edited passages that must be met: passages of so many words with so many words changed, dropped or put in.
RECALL, PASSAGE, PASSAGE_EDITS = 0.95, 20, 3
#: Words of item text in one block that is sent to all workers (about 150 bytes each in a worker's index).
BLOCK_WORDS = 500_000
#: Document words that one pass of the vectorised walk holds.
PASS_WORDS = 400_000
SEED = 20_240_117

_WORD = re.compile(rb"[0-9a-z]+")


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters or digits, ASCII-lowercased."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def _word_ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit identities of words, the same on every worker."""
    import xxhash

    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w, SEED)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def cgk_keys(ids: np.ndarray, starts: np.ndarray, words: int = WORDS, tables: int = 4) -> np.ndarray:
    """LSH keys (windows x tables) of the windows of ``words`` ids that begin at ``starts``.

    A walk that runs off its window writes a pad. Walk bits and sampled steps come from ``SEED``.
    """
    rng = np.random.default_rng(SEED)
    steps = WALK * words
    salts = rng.integers(1, 2**63, steps, dtype=np.uint64) | np.uint64(1)
    sampled = [set(rng.choice(steps, SAMPLED, replace=False).tolist()) for _ in range(tables)]
    at, keys = np.zeros(len(starts), np.int64), np.zeros((tables, len(starts)), np.uint64)
    last = max(set().union(*sampled))
    for j in range(last + 1):
        inside = at < words
        symbol = np.where(inside, ids[np.minimum(starts + at, len(ids) - 1)], np.uint64(7))
        for t in range(tables):
            if j in sampled[t]:
                keys[t] = _mix(keys[t] ^ (symbol + salts[j]))
        at += ((symbol * salts[j]) >> np.uint64(63)).astype(np.int64)
    return keys.T


@cache
def tables_for(recall: float, words: int = WORDS) -> int:
    """The fewest keys a window needs so that edited passages are met as often as ``recall`` asks, by a seeded simulation.

    A passage of ``PASSAGE`` words (``words`` at least) with ``PASSAGE_EDITS`` random edits is met where any of its windows shares a key with
    any window of the original. ``MOST_TABLES`` where that does not suffice.
    """
    rng = np.random.default_rng(SEED + 1)
    size, first = max(PASSAGE, words), []
    for _ in range(400):
        own = rng.integers(1, 2**62, size).tolist()
        other = list(own)
        for _ in range(PASSAGE_EDITS):
            at, kind = int(rng.integers(0, len(other))), int(rng.integers(0, 3))  # change, drop, put in
            other[at : at + (kind < 2)] = rng.integers(1, 2**62, int(kind != 1)).tolist()
        n, m = size - words + 1, max(len(other) - words + 1, 0)
        keys = cgk_keys(np.array(own + other, np.uint64), np.concatenate([np.arange(n), size + np.arange(m)]), words, MOST_TABLES)
        met = [len(np.intersect1d(keys[:n, t], keys[n:, t])) > 0 for t in range(MOST_TABLES)]
        first.append(met.index(True) + 1 if any(met) else MOST_TABLES + 1)
    return next((t for t in range(1, MOST_TABLES) if np.mean(np.array(first) <= t) >= recall), MOST_TABLES)


class ItemIndex:
    """Sorted keys of one block of items, with the item and word offset of each."""

    def __init__(self, items: list[tuple[int, str]], words: int, tables: int):
        known: dict[bytes, int] = {}
        self.n_tables = tables
        self.words, self.items, ids, starts, owner, offset, base = words, [], [], [], [], [], 0
        for item, text in items:
            w = words_of(text)
            self.items.append((item, w))
            n = max(len(w) - words + 1, 0)
            ids.append(_word_ids(w, known))
            starts.append(base + np.arange(n))
            owner.append(np.full(n, len(self.items) - 1))
            offset.append(np.arange(n))
            base += len(w)
        empty = [np.zeros(0, np.int64)]
        starts_, owner_, offset_ = (np.concatenate(x or empty) for x in (starts, owner, offset))
        keys = cgk_keys(np.concatenate(ids), starts_, words, tables) if len(starts_) else np.zeros((0, tables), np.uint64)
        self.tables = []
        for t in range(tables):
            order = np.argsort(keys[:, t], kind="stable")
            self.tables.append((keys[order, t], owner_[order], offset_[order]))
        self.filter = np.zeros(1 << 22, bool)
        for k, _, _ in self.tables:
            self.filter[(k >> np.uint64(42)).astype(np.int64)] = True

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window index, item index, item word offset) that share a key in some table, each once."""
        keys, seen = cgk_keys(ids, starts, self.words, self.n_tables), []
        for t, (sorted_keys, owner, offset) in enumerate(self.tables):
            maybe = np.flatnonzero(self.filter[(keys[:, t] >> np.uint64(42)).astype(np.int64)])
            low = np.searchsorted(sorted_keys, keys[maybe, t], "left")
            count = np.searchsorted(sorted_keys, keys[maybe, t], "right") - low
            hit = np.repeat(maybe, count)
            place = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            seen.append(np.stack([hit, owner[place], offset[place]], 1))
        return np.unique(np.concatenate(seen), axis=0)


def common_run(a: list[bytes], i: int, b: list[bytes], j: int) -> tuple[int, int, int]:
    """Start in a, start in b and length of the longest common run near the aligned positions (i, j).

    Looks along the diagonal through (i, j), from the first to the last word that differs around it.
    """
    low = high = 0
    while i - low > 0 and j - low > 0 and a[i - low - 1] == b[j - low - 1]:
        low += 1
    while i + high < len(a) and j + high < len(b) and a[i + high] == b[j + high]:
        high += 1
    return i - low, j - low, low + high


def edit_distance(a: list[bytes], b: list[bytes], most: int) -> int:
    """Levenshtein distance on words, most + 1 where it is over ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


HITS = "doc_id bigint, item_id bigint, shared_words int, window_edits int, n_windows bigint"


def leaked_passages(documents: DataFrame, items: DataFrame, words: int = WORDS, edits: int = 2, recall: float = RECALL) -> DataFrame:
    """Documents that hold a passage of an item: one row per (doc_id, item_id).

    shared_words is the longest run of consecutive words the candidates showed, window_edits the least
    edit distance (in words) between an item window and the document window that met it, n_windows the
    number of such windows within ``edits``. A pair comes out when a run has at least ``words`` words or a
    window is within ``edits``. Null or blank texts and ids, and items shorter than ``words``, give nothing;
    repeated rows give one row per pair; other columns are ignored.
    """
    documents = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    items = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.size(F.split("text", " "))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // BLOCK_WORDS))
    tables, out = tables_for(recall, words), None
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in own.toLocalIterator()]))
        found = documents.mapInPandas(_scan(index, words, edits, tables), HITS)
        if blocks > 1:  # one block at a time is held by the driver and the workers
            found = spill_table(found, "leaks")
            index.destroy()
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(
        F.max("shared_words").alias("shared_words"), F.min("window_edits").alias("window_edits"), F.sum("n_windows").alias("n_windows")
    )


#: The index of the block that this worker process used last.
_LAST: dict[tuple, ItemIndex] = {}


def _index(sent, words: int, tables: int) -> ItemIndex:
    name, items = sent.value
    key = (name, words, tables)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = ItemIndex(items, words, tables)
    return _LAST[key]


def _scan(sent, words: int, edits: int, tables: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item_index, known = _index(sent, words, tables), {}
        for batch in batches:
            held: list[tuple[int, list[bytes]]] = []
            size = 0
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                w = words_of(text)
                if len(w) < words:
                    continue
                held.append((doc, w))
                size += len(w)
                if size >= PASS_WORDS:
                    yield _hits(held, item_index, known, edits)
                    held, size = [], 0
                    if len(known) > 1_000_000:
                        known.clear()
            if held:
                yield _hits(held, item_index, known, edits)

    return scan


def _hits(docs: list[tuple[int, list[bytes]]], index: ItemIndex, known: dict, edits: int) -> pd.DataFrame:
    words, base, starts, owner = index.words, 0, [], []
    for d, (_, w) in enumerate(docs):
        n = len(w) - words + 1
        starts.append(base + np.arange(n))
        owner.append(np.full(n, d))
        base += len(w)
    first = np.cumsum([0, *(len(w) for _, w in docs)])
    ids = np.concatenate([_word_ids(w, known) for _, w in docs])
    starts, owner = np.concatenate(starts), np.concatenate(owner)
    best: dict[tuple[int, int], list[int]] = {}
    covered: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for window, item, j in index.candidates(ids, starts).tolist():
        d = int(owner[window])
        i = int(starts[window] - first[d])
        a, b = docs[d][1], index.items[item][1]
        done = covered[d, item]
        if i < done.get(i - j, -1):
            distance = 0
        else:
            distance = edit_distance(a[i : i + words], b[j : j + words], edits)
            run_a, _, run = common_run(a, i, b, j)
            if run >= words:
                done[i - j] = run_a + run - words + 1
                distance = 0
            if distance > edits:
                continue
            row = best.setdefault((d, item), [0, words, 0])
            row[0] = max(row[0], run)
        row = best[d, item]
        row[1] = min(row[1], distance)
        row[2] += 1
    return pd.DataFrame(
        [(docs[d][0], index.items[item][0], *row) for (d, item), row in best.items()],
        columns=["doc_id", "item_id", "shared_words", "window_edits", "n_windows"],
    )


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks, verbatim and edited, with their evidence."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share at least 12 consecutive words with an item."""
    return p8_passages(spark, sf_dir).where(F.col("shared_words") >= WORDS).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: documents it leaked into."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


_P8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)
"""
QUERIES = {"p8_found": p8_found, "p8_passages": p8_passages, "p8_items": p8_items}
SQL = {"p8_found": _P8_SQL, "p8_items": f"SELECT item_id, count(*) AS n_docs FROM ({_P8_SQL}) GROUP BY item_id"}

import itertools
import random

import pytest

from quernel.operators import changefeed as c
from quernel.operators.evidence import forks, pending_entries, row_ops
from quernel.plans.generations import current, publish, read_buckets, read_current

ENTRY = "stream_id string, repo_id string, device_fingerprint string, lamport bigint, op string, table_name string, row_pk string, synced_hash string, stated_lamport bigint, stated_device_fingerprint string, entry_hash string, lamport_note string"
TIP = "stream_id string, device_fingerprint string, lamport bigint, row_pk string"


def entry(dev, lam, op, pk, h=None, sl=None, sd=None, stream="s", repo="r", tab="t"):
    return (stream, repo, dev, lam, op, tab, pk, h, sl, sd, f"{dev}{lam}", None)


def state(spark, entries, tips):
    changes = c.accepted_changes(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(tips, TIP))
    return {r.row_pk: r.synced_hash for r in c.live_rows(c.fold_changes(changes)).collect()}


TIPS = [("s", "a", 10, "x"), ("s", "b", 10, None), ("s", "a", 3, None)]


def test_clock_ties_removals_and_restates(spark):
    rows = [
        entry("a", 1, "upsert", "k1", "h1"), entry("b", 2, "upsert", "k1", "h2"),
        entry("a", 3, "upsert", "k2", "small"), entry("b", 3, "upsert", "k2", "large"),
        entry("a", 4, "upsert", "k3", "x"), entry("a", 4, "remove", "k3"),
        entry("a", 2, "remove", "k4"), entry("a", 5, "upsert", "k4", "back"), entry("b", 9, "restate", "k4", None, 2, "a"),
        entry("b", 6, "upsert", "k5", "dead"), entry("b", 9, "restate", "k5", None, 7, "a"),
        entry("a", 11, "upsert", "k6", "above the tip"), entry("z", 1, "upsert", "k7", "no tip"),
        entry("b", 11, "restate", "k1", None, 9, "a"),
    ]
    want = {"k1": "h2", "k2": "small", "k4": "back"}
    assert state(spark, rows, TIPS) == want
    for seed in range(3):
        shuffled = rows * 2
        random.Random(seed).shuffle(shuffled)
        assert state(spark, shuffled, TIPS) == want


def test_nulls_empties_and_unknown_ops(spark):
    rows = [entry("a", 1, "upsert", "k", None), entry("a", 1, "upsert", None, "h"), entry(None, 1, "upsert", "n", "h"), entry("a", None, "upsert", "n", "h"), entry("a", 2, "restate", "n"), entry("a", 1, "merge", "n", "h")]
    assert state(spark, rows, TIPS) == {"k": None}
    assert state(spark, [], TIPS) == {}
    assert state(spark, rows, []) == {}


def test_fold_matches_brute_force_and_continues(spark):
    rng = random.Random(5)
    rows = [entry(rng.choice("ab"), rng.randint(1, 10), rng.choice(["upsert", "remove"]), rng.choice("pqrst"), f"h{k}") for k in range(300)]
    best = {}
    for r in rows:
        clock = (r[3], -ord(r[2]), r[4] == "remove", r[7] if r[4] == "upsert" else "")
        if clock > best.get(r[6], ((-1,), None))[0]:
            best[r[6]] = (clock, r[7] if r[4] == "upsert" else None)
    want = {k: v for k, (cl, v) in best.items() if not cl[2]}
    assert state(spark, rows, TIPS) == want
    tips = spark.createDataFrame(TIPS, TIP)
    first, second = (c.accepted_changes(spark.createDataFrame(x, ENTRY), tips) for x in (rows[:150], rows[150:]))
    again = c.fold_changes(second, c.fold_changes(first))
    assert {r.row_pk: r.synced_hash for r in c.live_rows(again).collect()} == want


def test_hot_key_is_folded_before_the_shuffle(spark):
    rows = [entry("a", k % 10 + 1, "upsert", "hot", f"h{k % 10:02d}") for k in range(2000)]
    assert state(spark, rows, TIPS) == {"hot": "h09"}


def test_publish_flips_a_pointer(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    assert current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        read_current(spark, root)
    one = publish(spark.range(3), root)
    assert current(spark, root) == one and read_current(spark, root).count() == 3
    two = publish(spark.range(5), root)
    assert current(spark, root) == two != one and read_current(spark, root).count() == 5


def test_row_ops_forks_and_pending(spark):
    live = spark.createDataFrame([("r", "t", "a", "1"), ("r", "t", "b", "2"), ("r", "t", "c", None)], "repo_id string, table_name string, row_pk string, synced_hash string")
    old = spark.createDataFrame([("r", "t", "a", "0"), ("r", "t", "b", "2"), ("r", "t", "b", "1"), ("r", "t", "d", "4"), ("r", "t", "c", None)], live.schema)
    assert {(x.row_pk, x.op) for x in row_ops(live, old).collect()} == {("a", "upsert"), ("d", "remove")}
    rows = spark.createDataFrame([entry("a", 1, "upsert", "k", "h"), ("s", "r", "a", 1, "upsert", "t", "k", "h", None, None, "other", None), entry("a", 12, "upsert", "k", "h")], ENTRY)
    assert [(x.lamport, x.n) for x in forks(rows).collect()] == [(1, 2)]
    assert [x.lamport for x in pending_entries(rows, spark.createDataFrame(TIPS, TIP)).collect()] == [12]


def test_stream_gives_the_batch_state(spark, tmp_path):
    from quernel.streaming.feeds import apply_feed

    rng = random.Random(9)
    rows = [entry(rng.choice("ab"), rng.randint(1, 10), rng.choice(["upsert", "remove"]), rng.choice("pqr"), f"h{k}") for k in range(60)]
    tips = spark.createDataFrame(TIPS, TIP)
    for k, part in enumerate(itertools.batched(rows, 20)):
        spark.createDataFrame(list(part), ENTRY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = apply_feed(stream, tips, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    query.awaitTermination(120)
    got = {r.row_pk: r.synced_hash for r in c.live_rows(read_buckets(spark, f"file://{tmp_path}/out")).collect()}
    assert got == state(spark, rows, TIPS)


def test_entries_above_the_tip_count_once_it_moves(spark, tmp_path):
    from quernel.streaming.feeds import apply_feed

    rng = random.Random(4)
    rows = [entry(rng.choice("ab"), rng.randint(1, 10), rng.choice(["upsert", "remove"]), rng.choice("pqrstu"), f"h{k}") for k in range(60)]
    moved = TIPS
    low = [(s, d, 3, k) for s, d, _, k in TIPS]
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(ENTRY).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for tips in (low, low, moved):
        apply_feed(stream, spark.createDataFrame(tips, TIP), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination(120)
        got = {r.row_pk: r.synced_hash for r in c.live_rows(read_buckets(spark, f"file://{tmp_path}/out")).collect()}
        assert got == state(spark, rows, tips)
    assert state(spark, rows, low) != state(spark, rows, moved)

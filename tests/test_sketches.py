import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernel.operators import clones, refine, sketches


def _texts(n, seed):
    """Texts of 20 to 300 words of a vocabulary that all share, some of them changed copies of others."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        if out and rng.random() < 0.5:
            words = list(rng.choice(out)[2].split())
            for _ in range(rng.randint(0, len(words) // 2)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 90)}"
            words = words[: rng.randint(max(20, len(words) // 2), len(words))]
        else:
            words = [f"w{rng.randint(0, 90)}" for _ in range(rng.randint(20, 300))]
        out.append((k, rng.choice(["x", "x", "y", None]), " ".join(words)))
    return out


@pytest.mark.parametrize("theta", [0.5, 0.7])
def test_pairs_equal_brute_force_and_few_candidates_are_kept(spark, theta, monkeypatch):
    monkeypatch.setattr(sketches, "LEAST_BLOCK", 4_000)  # several blocks
    monkeypatch.setattr(sketches, "PART_TOKENS", 5_000)
    texts = _texts(240, 5)
    prints = clones.fingerprints(spark.createDataFrame(texts, "id bigint, language string, text string"))
    reps = {}
    for k, lang, t in texts:
        reps.setdefault((lang or "", t), k)
    items = [(k, lang, Counter(t.split())) for (lang, t), k in reps.items()]
    want = {}
    for a, la, x in items:
        for b, lb, y in items:
            both, longest = (x & y).total(), max(x.total(), y.total())
            if a < b and la == lb and both >= theta * longest - 1e-9:
                want[a, b] = (x.total(), y.total(), both)
    marks = clones.class_marks(prints)
    got = {(r.id_a, r.id_b): (r.n_a, r.n_b, r.overlap) for r in clones.marked_pairs(marks, prints, theta).collect()}
    assert got == want
    # words are in most texts, so prefixes would join nearly all with all
    if theta == 0.7:
        likely = sketches.likely_pairs(marks.withColumn("changed", F.lit(True)), theta).count()
        assert len(want) <= likely <= len(want) + 600 < len(items) ** 2 / 8
    ids = marks.where("id % 3 = 0").select("id")
    some = {(r.id_a, r.id_b) for r in clones.marked_pairs(marks, prints, theta, ids).collect()}
    assert some == {(a, b) for a, b in want if a % 3 == 0 or b % 3 == 0}
    old = clones.marked_pairs(marks.where("id % 3 <> 0"), prints, theta)
    assert {(r.id_a, r.id_b) for r in refine.replaced_pairs(old, clones.marked_pairs(marks, prints, theta, ids), ids).collect()} == set(want)


def test_sketches_differ_in_no_more_bits_than_the_bags_in_occurrences():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 20, 200):
        bags = [rng.integers(0, 2 * n, n) * 0x1234567 for _ in range(6)]
        made = [np.frombuffer(s, np.uint8) for s in sketches.sketch(bags)]
        for a, x in zip(bags, made, strict=True):
            for b, y in zip(bags, made, strict=True):
                differ = (Counter(a.tolist()) - Counter(b.tolist())).total() + (Counter(b.tolist()) - Counter(a.tolist())).total()
                assert np.bitwise_count(x ^ y).sum() <= differ
    assert sketches.sketch([]) == [] and set(sketches.sketch([np.zeros(0, np.int64)])[0]) == {0}


def test_no_texts_give_no_pairs(spark):
    none = clones.fingerprints(spark.createDataFrame([(1, "x", "short"), (2, None, None)], "id bigint, language string, text string"))
    assert clones.clone_pairs(clones.bags(none)).count() == 0 and clones.print_pairs(none).count() == 0


def test_lcs_of_many_pairs_equals_the_table(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    pairs = [(rng.integers(0, v, a), rng.integers(0, v, b)) for v in (2, 9, 300) for a, b in ((0, 5), (7, 0), (1, 1), (63, 64), (64, 65), (128, 90), (200, 300), (300, 129))]
    pairs += [(x, x) for x, _ in pairs]
    assert clones.lcs_lengths(pairs).tolist() == [clones.lcs_length(s.tolist(), t.tolist()) for s, t in pairs]
    for s, t in pairs[:12]:
        table = [0] * (len(t) + 1)
        for x in s:
            last = 0
            for k, y in enumerate(t):
                table[k + 1], last = max(table[k + 1], table[k], last + 1 if x == y else 0), table[k + 1]
        assert clones.lcs_lengths([(s, t)]).tolist() == [table[-1]]

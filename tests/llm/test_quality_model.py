import random

import numpy as np
import pytest

from lendwell.llm import quality_model as q
from lendwell.llm.common import table

SCHEMA = "doc_id long, text string, score double, kept_row int"


def prose(rng, n):
    syllables = "an the er ing on tion sh ea ou re at st".split()
    out = []
    while len(out) < n:
        sentence = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(4, 14))]
        out += [*sentence[:-1], sentence[-1] + "."]
    return " ".join(out[:n])


def junk(rng, n):
    kind = rng.randrange(4)
    words = prose(rng, n).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["%%%", "***", "$$$"]) for w in words)
    if kind == 2:
        return " | ".join(words)
    return " ".join([words[0]] * n)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1) for r in rows], SCHEMA)


def test_planted_junk_goes_and_prose_stays(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(3, 400))) for i in range(500)]
    rows += [(1000 + i, junk(rng, rng.randint(30, 300))) for i in range(80)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (None, prose(rng, 50)), (3000, prose(rng, 60_000))]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["keep"] for r in q.classified(docs).collect()}
    assert len(got) == len(rows)
    good = [got[i] for i in [*range(500), None, 3000]]
    bad = [got[1000 + i] for i in range(80)]
    assert sum(good) / len(good) >= 0.99 and sum(bad) / len(bad) <= 0.05
    assert not got[2000] and not got[2001] and not got[2002]
    kept = q.kept(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, k in got.items() if k}


def test_held_out_labels(spark):
    """Given labels are not used in fitting, so all of them are held out."""
    folder = "/root/testdata/sf0.01"
    got = q.classified(table(spark, folder, "documents")).join(table(spark, folder, "labels"), "doc_id").collect()
    good = [r["keep"] for r in got if r["quality"] == 1]
    bad = [r["keep"] for r in got if r["quality"] == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


def test_estimation_finds_a_careless_labeller():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    votes = np.full((4000, len(q.LABELLERS)), q.ABSTAIN)
    votes[:, 1] = np.where(truth, q.GOOD, np.where(rng.random(4000) < 0.9, q.BAD, q.GOOD))
    votes[:, 2] = np.where(truth, q.GOOD, np.where(rng.random(4000) < 0.7, q.BAD, q.GOOD))
    pattern, at, count = np.unique(q.pattern_of(votes), return_inverse=True, return_counts=True)
    assert (q.votes_of(pattern)[at] == votes).all()
    chance = q.estimated(pattern, count.astype(float))[at]
    assert np.mean((chance >= 0.5) == truth) > 0.95


def test_same_texts_same_scores_and_empty_table(spark):
    rng = random.Random(2)
    text = prose(rng, 80)
    got = q.classified(frame(spark, [(i, text) for i in range(50)])).collect()
    assert len({r["score"] for r in got}) == 1
    assert q.classified(frame(spark, [])).count() == 0
    assert q.kept(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["x", "a b", "é" * 3000, "\x00 \x00"])
def test_signals_of_odd_texts(text):
    table_, count = q.signals([text, ""])
    assert np.isfinite(table_).all() and count[1] == 0


def estimated_by_hand(rows):
    """Expectation-maximisation over single texts' votes in plain Python."""
    chance = [0.1 if q.BAD in votes else 0.9 for votes in rows]
    labellers = range(len(rows[0]))
    for _ in range(q.EM_STEPS):
        good, bad = sum(chance), sum(1 - c for c in chance)
        prior = [(bad + 1) / (good + bad + 2), (good + 1) / (good + bad + 2)]
        rates = []
        for j in labellers:
            said = [(votes[j] == q.BAD, c) for votes, c in zip(rows, chance) if votes[j] != q.ABSTAIN]
            on_bad = (sum(1 - c for b, c in said if b) + 1) / (sum(1 - c for _, c in said) + 2)
            on_good = (sum(c for b, c in said if b) + 0.001) / (sum(c for _, c in said) + 1)
            rates.append((min(max(on_bad, 2 * q.FALSE_ALARMS), 0.99), min(on_good, q.FALSE_ALARMS)))
        chance = []
        for votes in rows:
            odds = list(prior)
            for j in labellers:
                if votes[j] != q.ABSTAIN:
                    odds = [o * (r if votes[j] == q.BAD else 1 - r) for o, r in zip(odds, rates[j])]
            chance.append(odds[1] / sum(odds))
    return chance


def test_expectation_maximisation_equals_plain_python():
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        low = rng.random() < 0.3
        rows.append([rng.choices([q.BAD, q.GOOD, q.ABSTAIN], [0.4 if low else 0.002, 0.5, 0.2])[0] for _ in q.LABELLERS])
    patterns = q.pattern_of(np.array(rows))
    different, counts = np.unique(patterns, return_counts=True)
    by_pattern = dict(zip(different.tolist(), q.estimated(different, counts.astype(float)).tolist()))
    want = estimated_by_hand(rows)
    assert np.allclose([by_pattern[p] for p in patterns.tolist()], want, atol=1e-9)

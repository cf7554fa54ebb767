import math
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest

from lendwell.llm import language_model
from lendwell.llm.elias_fano import EliasFano, Trie

SCHEMA = "doc_id long, text string, score double, batch string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.0, "clash") for r in rows], SCHEMA)


def by_hand(rows, prior):
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    count, context, pair = Counter(), Counter(), Counter()
    for out, words in zip(held, tokens):
        if not out:
            count.update(words)
            before = ["start", *words[:-1]]
            context.update(before)
            pair.update(zip(before, words))
    n, v = sum(count.values()), len(count)
    for (doc, _), out, words in zip(rows, held, tokens):
        single = [(count[w] + 1) / (n + v + 1) for w in words]
        both = zip(["start", *words[:-1]], words, single)
        score = sum(math.log10((pair[u, w] + prior * p) / (context[u] + prior)) for u, w, p in both)
        yield (doc, out, len(words), sum(w in count for w in words), n, sum(map(math.log10, single)), score)


@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(language_model, "BATCH_BYTES", 2000)
        monkeypatch.setattr(language_model, "PIECE_BYTES", 500)
        monkeypatch.setattr(language_model, "SHARD_TOKENS", 900)
        monkeypatch.setattr(language_model, "FREQUENT", 0.02)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"W{w}" for w in rng.zipf(1.5, rng.integers(1, 80)) % 500)) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "A null id"), (903, "É é x\x0by\x1fz"), (904, "long " * 20_000)]
    got = {r["doc_id"]: r for r in language_model.scored(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for doc, out, length, known, n, base, score in by_hand(rows, language_model.PRIOR):
        r = got[doc]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, length, known, n)
        assert r["base_score"] == pytest.approx(base)
        # A quantised probability is off by less than 0.00025 in log10.
        assert r["score"] == pytest.approx(score, abs=0.00025 * length)


def test_codes():
    chance = np.array([1.0, 0.999, 0.5, 1e-3, 1e-8, 1e-15])
    code = language_model.quantised(chance)
    assert code.min() >= 1 and (np.diff(code.astype(int)) > 0).all()
    assert np.abs(np.log10(language_model.probability(code)) - np.log10(chance)).max() < 0.00025


def test_repeats_and_empty_table(spark):
    got = language_model.scored(frame(spark, [(1, "a b c")] * 30)).collect()
    assert len(got) == 30 and len({tuple(r) for r in got}) == 1
    assert language_model.scored(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size,universe", [(0, 10), (1, 1), (7, 1 << 64), (2000, 1 << 40), (2000, 2500)])
def test_elias_fano(size, universe):
    rng = np.random.default_rng(size)
    values = np.sort(rng.integers(0, universe, size, dtype=np.uint64))
    asked = np.concatenate([values, rng.integers(0, universe, 300, dtype=np.uint64)])
    with tempfile.TemporaryDirectory() as folder:
        sequence = EliasFano(folder, "x", values, universe)
        assert (sequence[np.arange(size)] == values).all()
        place, equal = sequence.successor(asked)
        assert (place == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_trie_round_trip():
    rng = np.random.default_rng(1)
    contexts = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    words = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    keys = np.unique(rng.integers(0, len(contexts) * len(words), 5000, dtype=np.uint64))
    codes = rng.integers(1, 60000, len(keys)).astype(np.uint16)
    stored = dict(zip(keys.tolist(), codes.tolist()))
    c, w = (a.ravel() for a in np.meshgrid(np.arange(len(contexts)), np.arange(len(words))))
    with tempfile.TemporaryDirectory() as folder:
        got = Trie(folder, contexts, words, keys, codes).lookup(contexts[c], words[w])
    assert got.tolist() == [stored.get(int(a) * len(words) + int(b), 0) for a, b in zip(c, w)]

import hashlib
import random
import re

import pytest

from lendwell.llm import decontamination as d
from lendwell.llm.common import table

UP = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UP))


def by_hand(docs, items, window=10):
    """Every window of every item against every place of every document."""
    cut = []
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        if size:
            cut.append((item, size, {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}))
    out = []
    for doc, text in docs:
        own, hit, met = words(text), set(), set()
        for item, size, windows in cut:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    if item is not None:
                        met.add(str(item))
        listed = ",".join(sorted(met))
        out.append((doc, len(own), len(hit), len(met), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def judged(spark, docs, items, **more):
    frame = d.judged(
        spark.createDataFrame([(*r, ["x"], True) for r in docs], "doc_id long, text string, items array<string>, key boolean"),
        spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, windows int"),
        **more,
    )
    return sorted([tuple(r) for r in frame.collect()], key=str)


def cases():
    rng = random.Random(3)
    vocabulary = ["été", "AB", "ab", "x1", "日本", "z", "q", "🎉", "it", "s"]
    marks = [" ", ", ", "\n", "\x00", "'", "_", "  \t"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(n))

    items = [(i, text(n)) for i, n in enumerate([0, 1, 3, 9, 10, 11, 40, 40])]
    items += [(10, "one-word's"), (2, "z z z"), (None, text(14)), (100, None), (11, items[6][1]), (12, "ÀÉ ßeta w " * 5)]
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    docs += [(i + 100, text(5) + "; " + (t or "").upper() + " !" + text(3)) for i, (_, t) in enumerate(items)]
    docs += [(None, items[6][1]), (None, None), (7, ""), (8, "...!"), docs[3], docs[3], (9, text(20_000) + items[6][1])]
    return docs, items


def test_words_and_bytes():
    words_of = d.located(["Ab, é\x00c", None, "日本"])
    assert words_of.plain.decode() == "ab é c 日本 " and words_of.counts.tolist() == [3, 0, 1]


@pytest.mark.parametrize("windows", [d.SET_WINDOWS, 25])
def test_brute_force(spark, windows):
    docs, items = cases()
    docs, items = docs[:-1], [i for i in items if i[0] not in (1, 2)]
    got = d.scanned(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        windows=windows,
    ).collect()
    own = [
        (r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0)
        for r in got
    ]
    assert sorted(own, key=str) == by_hand(docs, items)
    assert sum(r["n_hit"] > 0 for r in got) >= 8


def test_short_items_and_long_text(spark):
    docs, items = cases()
    assert judged(spark, docs, items) == by_hand(docs, items)


def test_whole_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (table(spark, folder, n) for n in ("documents", "benchmark"))
    got = d.judged(docs, items)
    want = by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    assert any(r[-1] for r in want)


def test_segments_lose_no_window(spark):
    item = " ".join(f"w{i}" for i in range(3000))
    parts = d.segments(spark.createDataFrame([(1, item), (2, "a b")], "item_id long, text string"), 10, segment=128).collect()
    found = {tuple(w[i : i + 10]) for p in parts if p["item"] == "1" for w in [p["text"].split()] for i in range(len(w) - 9)}
    assert len(found) == 2991 and max(len(p["text"].split()) for p in parts) == 137
    assert sum(p["windows"] for p in parts) == 2992


@pytest.mark.parametrize("windows", [d.SET_WINDOWS, 5])
def test_cleaned(spark, windows):
    passage = "the quick brown fox jumps over the lazy dog again and again"
    other = "pack my box with five dozen liquor jugs said nobody"
    rows = [
        (1, f"Before. {passage.upper()}! After {other}."),
        (2, "clean text"),
        (3, None),
        (None, passage),
        (None, passage),
        (4, f"{passage} {other}"),
    ]
    docs = spark.createDataFrame([(d_, t, "k", 5) for d_, t in rows], "doc_id long, text string, key string, spans int")
    items = spark.createDataFrame([(1, passage), (2, other)], "item_id long, text string")
    got = d.cleaned(docs, items, windows=windows)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["key"], r["spans"]) for r in got.collect()), key=str) == sorted(
        [(1, "Before. ! After .", "k", 5), (2, "clean text", "k", 5), (3, None, "k", 5), (None, "", "k", 5), (None, "", "k", 5), (4, "", "k", 5)],
        key=str,
    )
    assert sorted(r["doc_id"] for r in d.cleaned(docs, items, "documents", windows=windows).collect()) == [2, 3]
    with pytest.raises(ValueError):
        d.cleaned(docs, items, "words")


def test_one_hash_for_different_windows():
    """Words decide, not hashes."""
    tests = d.test_set(["1", "2"], ["a b c d e f g h i j", "k l m n o p q r s t"], 10)
    tests.hashes[:] = tests.hashes[0]
    tests.known[:] = True
    words_of = d.located(["a b c d e f g h i j"])
    words_of_other = d.located(["u b c d e f g h i j"])
    real = d.window_hashes

    def same(words_, size):
        starts, hashes = real(words_, size)
        return starts, hashes * 0 + tests.hashes[0]

    d.window_hashes = same
    try:
        flags, met = d.confirmed(words_of, tests)
        assert flags.all() and met == {0: {0}}
        flags, met = d.confirmed(words_of_other, tests)
        assert not flags.any() and met == {}
    finally:
        d.window_hashes = real


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert d.judged(some.limit(0), items).count() == 0
    row = d.judged(some, items.limit(0)).first()
    assert (row["n_words"], row["n_hit"], row["items_sha256"]) == (3, 0, hashlib.sha256(b"").hexdigest())
    assert d.cleaned(some, items.limit(0)).first()["text"] == "a b c"

import re

import pytest

from lendwell.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, given, free = share * sum(sizes.values()), {}, set(names)
    while True:
        rate = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if rate * weight[s] > most * sizes[s]}
        if not above:
            return given | {s: rate * weight[s] for s in free}
        for s in above:
            given[s] = most * sizes[s]
            left -= given[s]
        free -= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_sums(spark):
    rows = [(i, "w " * (i % 13), f"s{i % 5}" if i % 3 else "hot") for i in range(600)]
    rows += [(1000 + i, "a b c\td", None) for i in range(40)] + [(2000, None, "empty"), (2001, "", "empty")]
    got = [r.asDict() for r in mixing.mixed(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    size = {d: words(t) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    sizes = {}
    for d, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[d]
    want = targets_by_hand(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        largest = max((size[d] for d in source if source[d] == s), default=0)
        assert abs(taken[s] - want[s]) <= largest / 2 + 1e-6


def taken_by_size(got):
    out = {}
    for r in got:
        size, target, words = out.get(r["source_size"], (0, r["target"], 0))
        out[r["source_size"]] = (size + r["size"], target, words + r["taken"])
    return out


@pytest.mark.parametrize("text", ["one", "one two three"])
def test_alike_rows_share_what_is_left(spark, text):
    """A source of rows alike in id and text whose target is neither its size nor twice as much."""
    rows = [(7, text, "b")] * 20_000 + [(8, "w " * 40_000 * len(text.split()), "a")]
    docs = frame(spark, rows).repartition(7)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    size, target, words = taken_by_size(got)[20_000 * len(text.split())]
    assert size < target < 2 * size and abs(words - target) <= 1
    mix = mixing.mix(docs).filter("source = 'b'").count()
    assert abs(mix * len(text.split()) - target) <= len(text.split()) / 2 + 1
    again = mixing.mixed(frame(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_alike_rows_with_other_columns_of_their_own(spark):
    rows = [(7, "one two", "b", i, "x") for i in range(501)] + [(8, "w " * 2000, "a", 0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns
    target = {r["source_size"]: r["target"] for r in mixing.mixed(docs).collect()}[1002]
    assert abs(2 * mix.filter("source = 'b'").count() - target) <= 2
    assert mix.filter("source = 'b'").select("size").distinct().count() == 501


def test_long_texts(spark):
    rows = [(1, "ab " * 400_000, "a"), (2, "ab", "a"), (3, "x y", "b")]
    got = {r["doc_id"]: r["size"] for r in mixing.mixed(frame(spark, rows)).collect()}
    assert got == {1: 400_000, 2: 1, 3: 2}


def test_same_on_every_run_and_layout(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 4}") for i in range(300)]
    one = mixing.mixed(frame(spark, rows)).collect()
    two = mixing.mixed(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_empty_table_and_mix_keeps_columns(spark):
    assert mixing.mixed(frame(spark, [])).count() == 0
    rows = [(i, "w w w", f"s{i % 3}") for i in range(90)]
    docs = frame(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs).collect()}
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {d: t * 3 for d, t in times.items()} == {d: t for d, t in taken.items() if t}

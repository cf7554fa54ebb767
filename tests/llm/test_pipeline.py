import os
import random
import re

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from lendwell.llm import jaccard_join, mixing, quality_model
from lendwell.llm.common import table
from lendwell.session import shared_folder

SMALL = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_stages_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, SMALL)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in quality_model.classified(docs).collect() if r["keep"]}
    assert {r["doc_id"] for r in good.collect()} == kept
    single = stages[1](spark, good, SMALL)
    assert single.columns == docs.columns
    near = jaccard_join.linked(good, corpus_pipeline.NEAR_SHINGLE, corpus_pipeline.NEAR_THRESHOLD)
    firsts = {r["component_id"] for r in near.collect() if r["n_shingles"]}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(firsts)
    assert sorted(firsts) == near_copies_by_hand([(r["doc_id"], r["text"].translate(LOWER)) for r in good.collect()])
    mixed = stages[2](spark, single, SMALL)
    assert mixed.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mixed(single).collect()}
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert times == {d: t for d, t in taken.items() if t}
    tokens = stages[3](spark, mixed, SMALL)
    assert tokens.filter("parity AND restored").count() == sum(times.values())


def near_copies_by_hand(rows):
    """Least id of each group of texts with a 5-word Jaccard of at least 0.8, over all pairs."""
    words = [[w for w in re.split("[\\x20\\x09-\\x0D]+", text) if w] for _, text in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in words]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def test_near_copies_by_five_words(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(base)
        for cut in (4, 16, 30, 60, 80):  # one run of words replaced, or words cut off
            texts += [base[:50] + [f"x{rng.randrange(10**9)}" for _ in range(cut)] + base[50 + cut :], base[: 200 - cut]]
        for changes in (2, 4, 8):
            texts.append([w if i % (200 // changes) else f"y{rng.randrange(10**9)}" for i, w in enumerate(base)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert sorted(r["doc_id"] for r in got.collect()) == near_copies_by_hand(rows)


def test_run_equals_its_stages(spark):
    docs = table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    want = sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in docs.collect())
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, SMALL).collect()
    # Only the last stage's rows are left in the shared folder.
    assert [n[:10] for n in set(os.listdir(folder)) - before if n.startswith("pipeline-")] == ["pipeline-3"]
    assert len(got) > 100 and sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in got) == want


def test_odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names of the stages' own."""
    rng = random.Random(2)
    vocabulary = ["the", "old", "house", "stood", "near", "a", "river", "and", "trees", "grew", "around", "it", "slowly"]
    sentence = lambda: " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(9)).capitalize() + "."
    prose = lambda n: " ".join(sentence() for _ in range(n))
    copy, long = prose(30), prose(3000)
    rows = [(i, prose(12), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (None, prose(12), "en", None, 1), (102, long, "en", "s1", 2)]
    rows += [(103, copy, "en", "s1", 3), (103, copy, "en", "s1", 3), (104, copy, "de", None, 4), (105, "!!! $$$ |||" * 30, "en", "s2", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(7) for c in ("size", "row", "point", "ids", "target")})
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len({t for d, t in kept if t == copy}) == 1 and {d for d, t in kept if t == copy} == {103}
    assert any(t == long for _, t in kept) and any(d is None for d, _ in kept)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(tokens) == len(kept) and all(r["restored"] and r["parity"] for r in tokens)


def test_empty_documents(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0

import hashlib

import pytest

from lendwell.llm import fingerprints


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, sketch string, n_chars int")


def texts(n=60):
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    return [" ".join(words[i : i + 3 + i * 5 % 90]) for i in range(n)]


def edited_by_hand(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[doc] = text[: len(text) - half] + after[:half]
    return out


@pytest.mark.parametrize("run_rows", [7, 2000])
def test_edited_texts_and_equal_fingerprints(spark, monkeypatch, run_rows):
    monkeypatch.setattr(fingerprints, "RUN_ROWS", run_rows)
    rows = [(i * i * 31, t) for i, t in enumerate(texts())]
    rows += [(-5, None), (-7, ""), (None, "null id, long enough"), (99_999, "é" * 30), (99_998, "short"), (99_990, "x" * 50_000)]
    want = edited_by_hand(rows)
    got = {r["doc_id"]: r for r in fingerprints.compared(frame(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for doc, text in want.items():
        assert got[doc]["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    plain = fingerprints.fingerprint(frame(spark, [(d, want[d]) for d in want]))
    # The fingerprint put together from parts is that of the edited text as a document.
    assert {r["doc_id"]: r["fingerprint"] for r in plain.collect()} == {d: r["edited_fingerprint"] for d, r in got.items()}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())


def syncmers(text, order, k=12, s=5):
    """Closed syncmers by definition: lowest inner substring first or last."""
    out = set()
    for i in range(len(text) - k + 1):
        inner = [order[text[i + j : i + j + s]] for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.add(text[i : i + k])
    return out


def test_anchors_by_definition(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(texts(20))]
    inner = sorted({t[i : i + 5] for _, t in rows for i in range(len(t) - 4)})
    hashes = spark.createDataFrame([(g,) for g in inner], "g string").select("g", F.hash("g").alias("h")).collect()
    order = {r["g"]: r["h"] for r in hashes}
    df = spark.createDataFrame(rows, "doc_id long, body string").withColumn(
        "anchors", F.expr(fingerprints.anchor_expression("body"))
    )
    for r in df.collect():
        found = {r["body"][i : i + 12] for i, a in enumerate(r["anchors"]) if a is not None}
        assert found == syncmers(r["body"], order)


def test_likeness_is_near_jaccard(spark):
    rows = [(i, " ".join(f"t{(i * 37 + j * j) % 997}" for j in range(300))) for i in range(30)]
    got = {r["doc_id"]: r for r in fingerprints.compared(frame(spark, rows)).collect()}
    want = edited_by_hand(rows)
    for doc, text in rows:
        a = {text[i : i + 12] for i in range(len(text) - 11)}
        b = {want[doc][i : i + 12] for i in range(len(want[doc]) - 11)}
        assert abs(got[doc]["near_edited"] - len(a & b) / len(a | b)) < 0.25


def test_shared_ids_single_row_and_empty_table(spark):
    rows = [(1, "aaaa bbbb cccc dddd")] * 40 + [(1, "other text of the same id"), (0, "the next document's text")]
    got = fingerprints.compared(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    edited = {r["edited_sha256"] for r in got if r["doc_id"] == 1}
    assert edited == {
        hashlib.sha256((t[: len(t) - len(t) // 2] + "the next document's text"[: len(t) // 2]).encode()).hexdigest()
        for t in ("aaaa bbbb cccc dddd", "other text of the same id")
    }
    one = fingerprints.compared(frame(spark, [(3, "only one text here")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"only one only one").hexdigest() or one[0]["near_next"] == 1.0
    assert one[0]["near_next"] == 1.0
    assert fingerprints.compared(frame(spark, [])).count() == 0

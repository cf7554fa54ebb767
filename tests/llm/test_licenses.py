import random
import re

import pytest

from lendwell.llm import licenses
from lendwell.llm.common import table

LOWER = {c: c + 32 for c in range(65, 91)}
MIT = licenses.TEMPLATES["MIT"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, license string, places double")


def noise(rng, n):
    return " ".join(f"n{rng.randrange(5000)}" for _ in range(n))


def test_every_template_at_every_place(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for name, text in licenses.TEMPLATES.items():
        for before in (0, 1, 7, 50, 333):
            doc = len(rows)
            rows.append((doc, f"{noise(rng, before)} {text.upper()} {noise(rng, 40)}"))
            want.add((doc, name))
    rows += [(5000 + i, noise(rng, 200)) for i in range(50)] + [(6000, None), (6001, ""), (6002, "MIT License")]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scanned(frame(spark, rows)).collect()}
    assert want <= got.keys() and all(doc < 5000 for doc, _ in got)
    # Other licenses than the planted one only where their words stand in it.
    for doc, name in got.keys() - want:
        assert got[doc, name]["containment"] >= licenses.CONTAINMENT
    assert all(got[key]["containment"] == 1.0 for key in want)


def test_places_and_edits(spark):
    rng = random.Random(2)
    words = MIT.split()
    words[30] = "changed"
    rows = [
        (1, f"{noise(rng, 20)} {MIT} {noise(rng, 300)} {MIT}"),
        (2, noise(rng, 9) + " " + " ".join(words)),
        (3, " ".join(MIT.split()[:20])),
        (None, MIT),
        (4, noise(rng, 60_000) + " Released under the MIT License. " + noise(rng, 10)),
        (5, "Released under the MIT License."),
        (5, "Released under the MIT License."),
    ]
    got = sorted(licenses.scanned(frame(spark, rows)).collect(), key=str)
    found = {(r["doc_id"], r["license"]): r for r in got}
    assert found[1, "MIT"]["places"] == 2 and found[1, "MIT"]["first_word"] == 20
    assert 0.8 <= found[2, "MIT"]["containment"] < 1
    assert (3, "MIT") not in found and (None, "MIT") in found
    assert found[4, "MIT (line)"]["first_word"] == 60_000
    assert sum(r["doc_id"] == 5 for r in got) == 2


def test_bands_miss_less_than_promised():
    """Jaccard 1/4 is the least similarity of a piece and its window."""
    rng = random.Random(3)
    rows = [(i, f"{noise(rng, rng.randrange(30))} Licensed under CC BY-NC 4.0. {noise(rng, 30)}") for i in range(400)]
    import pandas as pd

    out = pd.concat(licenses.scanner(licenses.TEMPLATES)([pd.DataFrame(rows, columns=["doc_id", "text"])]))
    assert (out["license"] == "CC-BY-NC-4.0 (line)").sum() == 400


def test_short_templates_and_empty_table(spark):
    with pytest.raises(ValueError):
        licenses.Index({"short": "only four words here"})
    assert licenses.scanned(frame(spark, [])).count() == 0


def by_hand(texts, width):
    """Texts and templates of which 0.8 of the shingles stand in some run of words of a width, over all runs."""
    cut = lambda text: [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOWER)) if w]
    found = set()
    for name, template in licenses.TEMPLATES.items():
        own = cut(template)
        wanted = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        for doc, text in texts:
            words = cut(text)
            here = [tuple(words[i : i + 5]) in wanted for i in range(len(words) - 4)]
            if sum(here) < 0.8 * len(wanted):
                continue
            size = width(len(own)) - 4
            runs = (words[i : i + size + 4] for i in range(max(len(here) - size, 0) + 1))
            if any(len({tuple(r[j : j + 5]) for j in range(len(r) - 4)} & wanted) >= 0.8 * len(wanted) for r in runs):
                found.add((doc, name))
    return found


def test_whole_table_between_two_brute_forces(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {(r["doc_id"], r["license"]) for r in licenses.scanned(docs).collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    certain, possible = by_hand(texts, lambda n: n), by_hand(texts, lambda n: 4 * n + 24)
    assert certain <= got <= possible and len(certain) > 3

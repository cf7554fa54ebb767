import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lendwell.llm import token_alignment as t
from lendwell.llm.common import table

ODD = [
    "", " ", "  a  b ", "\n\n x", "a \n  b\t c", "日本語 test 🎉", "\x00a", "aaa aaaa aaaaaaaaaaaa", " x y", "x　 y", " lead",
    "trail  ", "end ", "w" * 3000, "plain words, with a stop.", "tab\tand\r\nlines \x85 z", "ÀÉ ñandú Straße", "x" + " " * 50 + "y",
    "a▁b", "<|endoftext|> <s> <unk> </s> <0x0A>", "don't we'll I'm", "123456 7 89,000.5", "\x1c \x1d z", "▁", "é́ ﷽ ​ q",
]


def by_hand(texts):
    """Whole texts by both libraries, and every pair of tokens compared."""
    coder = Tokenizer.from_file(t.BYTE_FILE)
    coder.encode_special_tokens = True
    processor = sentencepiece.SentencePieceProcessor(model_file=t.PIECE_FILE)
    table_ = t.byte_of()
    rows, counts = [], Counter()
    for doc, text in texts:
        a, b = [], []
        if text:
            a = [(i, bytes(table_[c] for c in coder.id_to_token(i))) for i in coder.encode(f" {text}", add_special_tokens=False).ids]
            b = [(i, t.piece_bytes(processor.id_to_piece(i), processor.is_byte(i))) for i in processor.encode(text)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == f" {text}".encode():
                a, b = [], []

        def placed(tokens):
            out, at = [], 0
            for i, own in tokens:
                out.append((i, at, at + len(own)))
                at += len(own)
            return out

        a, b = placed(a), placed(b)
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [
            ",".join(str(i) for i, _, e in a if s < e <= end) + "|" + ",".join(str(i) for i, _, e in b if s < e <= end)
            for s, end in zip([0, *both], both)
        ]
        links, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        counts.update(links)
        rows.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(
        (
            (doc, n_a, n_b, n_groups, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha)
            for doc, n_a, n_b, n_groups, links, sha in rows
        ),
        key=str,
    )


def compared(spark, rows, **more):
    frame = spark.createDataFrame([(*r, [1], "x") for r in rows], "doc_id long, text string, pairs array<int>, row string")
    got = t.compared(frame, **more)
    assert got.columns == t.RESULT
    return sorted([tuple(r) for r in got.collect()], key=str)


@pytest.mark.parametrize("frequent", [t.FREQUENT, 40, 0])
def test_odd_texts(spark, frequent):
    rows = list(enumerate(ODD)) + [(None, "no id"), (100, None), (7, ODD[7]), (7, ODD[7])]
    got = compared(spark, rows, frequent=frequent)
    assert got == by_hand(rows)
    by_id = {r[0]: r for r in got}
    assert by_id[ODD.index("a▁b")][1:] == (0,) * 6 + ("",) and by_id[ODD.index("w" * 3000)][1] > 0


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = sorted([tuple(r) for r in t.compared(docs).collect()], key=str)
    assert got == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_long_texts_in_blocks_and_small_caches(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["word", "uncommon", "naïve", "x", "日本", "42", "supercalifragilistic"]) + rng.choice([" ", "  ", "\n", ", "]) for _ in range(6000))
    coders = t.Coders(t.file_text(t.BYTE_FILE), t.file_bytes(t.PIECE_FILE))
    whole = t.Aligner.__new__(t.Aligner)
    whole.coders = coders
    (one,) = [s for some in whole([text]) for s in some]
    monkeypatch.setattr(t, "BLOCK_CHARS", 100)
    monkeypatch.setattr(t, "KNOWN_PARTS", 10)
    several = [s for some in whole(["", text, "a b", "", "c"]) for s in some]
    two = several[1]
    assert [s.row for s in several] == list(range(5)) and len(two.pairs) > 100
    for name in t.NUMBERS:
        assert getattr(one, name) == getattr(two, name)
    assert one.digest.hexdigest() == two.digest.hexdigest()

    def summed(state):
        out = Counter()
        for p, n in zip(state.pairs, state.times):
            for k, v in zip(p.tolist(), n.tolist()):
                out[k] += v
        return out

    assert summed(one) == summed(two)


def test_full_caches_keep_the_parts_at_hand(monkeypatch):
    monkeypatch.setattr(t, "KNOWN_PARTS", 3)
    own = t.coders(t.file_text(t.BYTE_FILE), t.file_bytes(t.PIECE_FILE))
    coders = object.__new__(t.Coders)
    coders.__dict__.update(own.__dict__, known={}, odd=set())
    asked = []
    monkeypatch.setattr(coders, "learn_alone", lambda parts: asked.append(sorted(parts)) or t.Coders.learn_alone(coders, parts))
    coders.fast = None
    for parts in ({"a", "b", "c", "d"}, {"a", "b", "x"}, {"c"}):
        coders.learn(parts)
    assert asked == [["a", "b", "c", "d"], ["x"], ["c"]]


def test_walk_against_sets():
    rng = random.Random(11)
    for _ in range(400):
        total = rng.randrange(1, 120)
        keep = rng.choice([0.1, 0.5, 0.9, 1.0])
        a = sorted({total, *(x for x in range(1, total) if rng.random() < keep)})
        b = sorted({total, *(x for x in range(1, total) if rng.random() < keep)})
        if rng.random() < 0.3:
            b = sorted({total, *(x for x in a if rng.random() < 0.95)})
        got = t.walk(a, b)
        both = [x for x in a if x in set(b)]
        assert [a[i - 1] for i in got[0]] == both == [b[j - 1] for j in got[1]]
        spans_a, spans_b = list(zip([0, *a], a)), list(zip([0, *b], b))
        want = [(i, j) for i, (s, e) in enumerate(spans_a) for j, (u, v) in enumerate(spans_b) if max(s, u) < min(e, v)]
        assert [(int(i), int(j)) for i, j in zip(*t.links(np.array(a), np.array(b)))] == want


def test_probes_grow_with_the_run(monkeypatch):
    """A stretch of n ends that are one to one takes about log n comparisons."""

    class Counting(list):
        slices = 0

        def __getitem__(self, at):
            Counting.slices += isinstance(at, slice)
            return list.__getitem__(self, at)

    a = Counting([*range(1, 5001), 5003])
    b = [*range(1, 5001), 5001, 5003]
    got = t.walk(a, b)
    assert len(got[0]) == 5001 and Counting.slices < 40


def test_empty_table(spark):
    assert compared(spark, []) == []

"""Quality classifier from weak labels: labellers, expectation-maximisation, hashed linear scorer.

1. Ten heuristic labellers vote good, bad or nothing on every text. Spark counts how often
   each combination of votes occurs in all texts; there are at most 3 ** 10 of them.
2. Expectation-maximisation over these counts estimates how often the labellers vote what on
   good and on bad texts, and from it the probability that a text with given votes is good.
   It starts from the majority of votes, which settles which class is which.
3. A logistic scorer on hashed features (byte trigrams and binned signals) is fitted to those
   probabilities on a sample of at most about ``SAMPLE_ROWS`` texts, chosen by hash. All texts
   are then scored whole.

Cases: a null or empty text has one vote, bad; labellers that need more words than there are
abstain, and a text on which all abstain gets the share of good texts; equal texts get equal
scores; without texts nothing is fitted and no rows come out; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell.llm.common import PIECE_ROWS, give_back, text_of
from lendwell.llm.words import CHUNK_BYTES, mixed, words_of

GOOD, BAD, ABSTAIN = 1, 0, 2
FEATURE_BITS = 10
FEATURES = 1 << FEATURE_BITS
SAMPLE_ROWS = 6000
EM_STEPS = 100
FALSE_ALARMS = 0.002
FIT_STEPS = 12
RIDGE = 1e-4
THRESHOLD = 0.5

# Signals with the limits from and to which a labeller votes.
# name, least number of words, bad below, good from, good to, bad above
LABELLERS = (
    ("no_words", 0, 0.5, 2.0, 1.0, float("inf")),
    ("symbols", 5, -1.0, 0.0, 0.02, 0.06),
    ("capitals", 5, -1.0, 0.0, 0.25, 0.5),
    ("exclamations", 5, -1.0, 0.0, 0.05, 0.25),
    ("bars", 5, -1.0, 0.0, 0.02, 0.2),
    ("top_word", 20, -1.0, 0.0, 0.15, 0.3),
    ("different_words", 50, 0.12, 0.3, float("inf"), float("inf")),
    ("repeats", 20, -1.0, 0.0, 0.05, 0.15),
    ("sentence_ends", 30, 0.005, 0.02, 0.3, 0.8),
    ("word_length", 5, 2.0, 3.0, 9.0, 14.0),
)
SIGNALS = [name for name, *_ in LABELLERS]
PATTERNS = 3 ** len(LABELLERS)
BINS = 8


def classes() -> np.ndarray:
    """Bit per byte class: letter 1, capital 2, symbol 4, exclamation mark 8, bar 16, sentence end 32."""
    table = np.zeros(256, np.uint8)
    for code in range(256):
        mark = chr(code)
        letter = code >= 128 or mark.isalpha()
        plain = letter or mark.isdigit() or mark.isspace() or mark in ".,;:!?'\"()-"
        table[code] = (
            letter + 2 * ("A" <= mark <= "Z") + 4 * (not plain) + 8 * (mark == "!") + 16 * (mark == "|") + 32 * (mark in ".?!")
        )
    return table


CLASSES = classes()


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over each text's bytes."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[starts])


def signals(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signals by text and labeller, and the number of words."""
    raw = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    kinds = CLASSES[data]
    letters, capitals, symbols, bangs, bars = (per_text(kinds >> bit & 1, starts) for bit in range(5))
    space = data <= 32
    ends = (kinds >> 5 & 1).astype(bool)
    last = np.flatnonzero(ends[:-1] & space[1:])
    sentence_ends = np.diff(np.searchsorted(last, starts))
    sizes = per_text(~space, starts)

    words = words_of(texts)
    count = words.counts
    order = np.lexsort((words.hashes, words.docs))
    docs, hashes = words.docs[order], words.hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(docs)))
    same = np.zeros(len(words.hashes), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.docs[1:] == words.docs[:-1])
    repeats = np.bincount(words.docs[same], minlength=len(texts))
    different = np.bincount(docs[first], minlength=len(texts))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, docs[first], runs)
    some = np.maximum(count, 1)
    table = np.column_stack(
        [
            np.minimum(count, 1),
            symbols / np.maximum(sizes, 1),
            capitals / np.maximum(letters, 1),
            bangs / some,
            bars / some,
            most / some,
            # Long texts use few new words: the measure is what a text of 200 words could have.
            different / np.minimum(some, 200),
            repeats / some,
            sentence_ends / some,
            sizes / some,
        ]
    )
    return table, count


def votes(table: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.full(table.shape, ABSTAIN, np.int64)
    for j, (_, words, bad_below, good_from, good_to, bad_above) in enumerate(LABELLERS):
        value = table[:, j]
        out[(value >= good_from) & (value <= good_to), j] = GOOD
        out[(value < bad_below) | (value > bad_above), j] = BAD
        out[count < words, j] = ABSTAIN
    return out


def pattern_of(vote: np.ndarray) -> np.ndarray:
    return vote @ (3 ** np.arange(vote.shape[1]))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def features(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Hashed features by text, each row of length 1 per kind."""
    raw = [t.encode("utf-8", "surrogatepass") + b"\n\n\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    code = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761)
    slot = (code >> np.uint32(32 - FEATURE_BITS)).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    inside = owner[:-2] == owner[2:]
    flat = np.bincount(owner[:-2][inside] * FEATURES + slot[inside], minlength=len(raw) * FEATURES)
    grams = np.sqrt(flat.reshape(len(raw), FEATURES))
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
    bins = np.minimum((np.sqrt(np.clip(table, 0, None)) * BINS).astype(np.uint64), np.uint64(3 * BINS))
    for j in range(table.shape[1]):
        place = mixed(bins[:, j] + np.uint64(1000 * (j + 1))) >> np.uint64(64 - FEATURE_BITS)
        grams[np.arange(len(raw)), place.astype(np.int64)] += 1 / len(LABELLERS) ** 0.5
    return grams


def in_pieces(texts: list[str]) -> Iterator[list[str]]:
    piece, size = [], 0
    for text in texts:
        if piece and (size + len(text) > CHUNK_BYTES or len(piece) >= PIECE_ROWS):
            yield piece
            piece, size = [], 0
        piece.append(text)
        size += len(text)
    if piece:
        yield piece
    give_back()


def estimated(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of a good text by pattern of votes (expectation-maximisation).

    Labellers look for different faults, so most of them call most bad texts good; what holds
    them together is that a good text is rarely called bad, at most in FALSE_ALARMS of cases.
    Abstaining says nothing.
    """
    vote = votes_of(patterns)
    said = vote != ABSTAIN
    called_bad = vote == BAD
    chance = np.where(called_bad.any(axis=1), 0.1, 0.9)
    for _ in range(EM_STEPS):
        weight = np.column_stack([counts * (1 - chance), counts * chance])
        prior = (weight.sum(axis=0) + 1) / (weight.sum() + 2)
        # Rate of bad votes by labeller, on bad texts and on good ones
        rate = (called_bad.T @ weight + [1, 0.001]) / (said.T @ weight + [2, 1])
        rate[:, 1] = np.minimum(rate[:, 1], FALSE_ALARMS)
        rate[:, 0] = np.clip(rate[:, 0], 2 * FALSE_ALARMS, 0.99)
        log = np.log(prior) + called_bad @ np.log(rate) + (said & ~called_bad) @ np.log1p(-rate)
        chance = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return chance


def fitted(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Weights and, last, the constant of a ridge logistic model by Newton steps."""
    x = np.column_stack([rows, np.ones(len(rows))])
    weights = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE * len(x))
    for _ in range(FIT_STEPS):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (chance - wanted) + ridge * weights
        curve = (x * (chance * (1 - chance))[:, None]).T @ x
        curve[np.diag_indices_from(curve)] += ridge
        change = np.linalg.solve(curve, slope)
        weights = weights - change
        if np.abs(change).max() < 1e-3:
            break
    return weights


@dataclass(frozen=True)
class Model:
    chances: dict[int, float]  # by pattern of votes
    share: float  # of good texts
    weights: np.ndarray


def measured(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        parts = [pattern_of(votes(*signals(piece))) for piece in in_pieces(batch.tolist())]
        yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))


def sampled(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows: list[tuple[int, bytes]] = []
        for piece in in_pieces(batch.tolist()):
            table, count = signals(piece)
            rows += zip(
                pattern_of(votes(table, count)).tolist(),
                [row.tobytes() for row in features(piece, table).astype(np.float32)],
            )
        yield pd.DataFrame(rows, columns=["pattern", "features"])


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Labellers' accuracies from all texts, scorer from a bounded sample."""
    text = text_of("text")
    pattern = F.pandas_udf(measured, "long")
    counted = docs.select(pattern(text).alias("pattern")).groupBy("pattern").count().collect()
    if not counted:
        return None
    patterns = np.array([r["pattern"] for r in counted])
    counts = np.array([r["count"] for r in counted], float)
    chance = estimated(patterns, counts)
    chances = dict(zip(patterns.tolist(), chance.tolist()))
    share = float((chance * counts).sum() / counts.sum())
    drawn = F.pmod(F.xxhash64(text, F.lit("sample")), F.lit(1 << 31)) < int(min(1.0, sample_rows / counts.sum()) * (1 << 31))
    picked = docs.select(text.alias("text")).filter(drawn).dropDuplicates(["text"])
    rows = picked.select(F.pandas_udf(sampled, "pattern long, features binary")("text").alias("s")).select("s.*").collect()
    if not rows:
        return Model(chances, share, np.zeros(FEATURES + 1))
    # Arrival order must not matter for the fit.
    rows.sort(key=lambda r: (r["pattern"], bytes(r["features"])))
    x = np.stack([np.frombuffer(r["features"], np.float32) for r in rows]).astype(float)
    return Model(chances, share, fitted(x, np.array([chances.get(r["pattern"], share) for r in rows])))


def scorer(model: Model):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            parts = []
            for piece in in_pieces(batch.tolist()):
                table, count = signals(piece)
                pattern = pattern_of(votes(table, count))
                # Summed row by row: a matrix product may round rows differently by their place.
                line = (features(piece, table) * model.weights[:-1]).sum(axis=1) + model.weights[-1]
                score = np.where(count > 0, 1 / (1 + np.exp(-line)), 0.0)
                label = [model.chances.get(p, model.share) for p in pattern.tolist()]
                parts.append(pd.DataFrame({"label_probability": label, "score": score}))
            yield pd.concat(parts) if parts else pd.DataFrame({"label_probability": [], "score": []}, dtype=float)

    return F.pandas_udf(run, "label_probability double, score double")


def score_of(model: Model, column: str = "text") -> Column:
    """Struct of the weak label's probability and the scorer's, for a text column."""
    return scorer(model)(text_of(column))


def classified(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, label_probability, score, keep`` for every row of ``docs`` (doc_id, text)."""
    model = fit(docs)
    if model is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, label_probability double, score double, keep boolean")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_of(model).alias("s")).select(
        "doc_id", "s.label_probability", "s.score", (F.col("s.score") >= threshold).alias("keep")
    )


def kept(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier keeps."""
    model = fit(docs)
    if model is None:
        return docs
    own = docs.columns
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("kept_row"), score_of(model).alias("kept_score"))
    return marked.filter(F.col("kept_score.score") >= threshold).select(
        *[F.col("kept_row").getField(c).alias(c) for c in own]
    )

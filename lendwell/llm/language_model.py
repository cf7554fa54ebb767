"""Bigram language model: counts over the corpus, Elias-Fano tries, scores of whole texts.

Texts become batches of word hashes. A batch sends each shard its contexts with their counts and
its different bigrams with theirs; a shard belongs to a hash range of contexts, and successors
of very frequent contexts are spread over all shards. Each shard adds up what the training texts
sent and builds a two-level trie in memory-mapped files: contexts, and successors with quantised
smoothed probabilities. It answers every batch with one code per bigram, in the batch's order.
Batches then sum up their texts. Counts of the very frequent contexts, a bounded list, are summed
beforehand and given to all shards.

The model is a bigram model with a Dirichlet prior: P(w | u) = (c(uw) + m P(w)) / (c(u) + m), where
P(w) = (c(w) + 1) / (N + V + 1). The trie keeps log10 of c(uw) / (c(u) + m) in 16 bits, off by less
than 0.00025. A start mark is the context of a text's first word; the end mark is a token.

Cases: a null or empty text has one token, the end; a null id counts as the text '' when
training texts are chosen; without training texts all counts are 0; repeated rows each count and
each get a row; very long texts make batches of their own. Words are told apart by 64-bit hashes,
successors of a context by 48 bits of them.
No documents give no rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell.llm.common import text_of
from lendwell.llm.elias_fano import Trie
from lendwell.llm.words import mixed, words_of
from lendwell.session import checkpointed, release

PRIOR = 200.0
BATCH_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
SHARD_TOKENS = 500_000
# Contexts with this share of the tokens of a sample are spread; at most 1 / share of them.
FREQUENT, SAMPLE_DOCS = 0.0005, 3000
FOLDS, HELD_FOLD = 7, 2
# Fixed values that stand for the marks at a text's start and end.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
LOWEST = -16.0
CODES = 65534

BATCH_SCHEMA = "batch string, tokens long, docs binary, words binary, ranks binary, spread_counts array<long>"
MESSAGE_SCHEMA = "shard int, batch string, contexts binary, counts binary, sizes binary, successors binary, pair_counts binary"
REPLY_SCHEMA = "batch string, shard int, counts binary, codes binary, shard_tokens long, shard_words long"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def squeezed(values: np.ndarray) -> bytes:
    """An array as bytes, its byte planes one after the other, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def restored(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def shortened(hashes: np.ndarray) -> bytes:
    """Six bytes of each hash: enough to tell the successors of one context apart."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def lengthened(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def quantised(chance: np.ndarray) -> np.ndarray:
    """Codes from 1: the root of -log10, so that steps are finest where probabilities are high."""
    return 1 + np.rint(np.sqrt((np.log10(chance) / LOWEST).clip(0, 1)) * CODES).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (((code.astype(np.float64) - 1) / CODES) ** 2 * LOWEST)


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def batches(spread: np.ndarray):
    """Texts to batches: per text its id, fold and length, and the ids of its words in the batch."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return in_batches(frames, spread)

    return run


def in_batches(frames: Iterable[pd.DataFrame], spread: np.ndarray) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    number = held = 0
    rows: list[pd.DataFrame] = []
    hashes: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def batch() -> pd.DataFrame:
        frame = pd.concat(rows, ignore_index=True)
        flat, place = np.unique(np.concatenate(hashes), return_inverse=True)
        # Frequent words get small numbers, which compress better.
        order = np.argsort(-np.bincount(place, minlength=len(flat)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        length = np.concatenate(counts)
        docs = np.zeros(len(frame), [("doc_id", "<i8"), ("null", "?"), ("train", "?"), ("count", "<i8")])
        docs["doc_id"], docs["null"] = frame["doc_id"].fillna(0), frame["doc_id"].isna()
        docs["train"], docs["count"] = frame["train"], length
        return pd.DataFrame(
            {
                "batch": [f"{part}-{number}"],
                "tokens": [int(length.sum() + len(length))],
                "docs": [docs.tobytes()],
                "words": [squeezed(flat[order])],
                "ranks": [squeezed(rank[place])],
                "spread_counts": [spread_counts(flat, place, docs)],
            }
        )

    def spread_counts(flat: np.ndarray, place: np.ndarray, docs: np.ndarray) -> np.ndarray:
        uses = np.bincount(place[np.repeat(docs["train"], docs["count"])], minlength=len(flat))
        at = np.minimum(np.searchsorted(flat, spread), max(len(flat) - 1, 0))
        found = np.where(flat[at] == spread, uses[at], 0) if len(flat) else np.zeros(len(spread), np.int64)
        return np.where(spread == START, int(docs["train"].sum()), found)

    for frame in frames:
        sizes = frame["text"].str.len().to_numpy()
        start = 0
        while start < len(frame):
            end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), PIECE_BYTES)))
            piece = frame.iloc[start:end]
            words = words_of(piece["text"].tolist())
            rows.append(piece[["doc_id", "train"]])
            hashes.append(words.hashes)
            counts.append(words.counts)
            held += int(sizes[start:end].sum())
            start = end
            if held >= BATCH_BYTES:
                yield batch()
                number, held = number + 1, 0
                rows, hashes, counts = [], [], []
    if rows:
        yield batch()


@dataclass
class Batch:
    """A batch's tokens as places in its sorted list of marks and words, and its different bigrams."""

    docs: np.ndarray
    words: np.ndarray  # hashes, ascending; with both marks
    token: np.ndarray  # every text's words and its end mark
    owner: np.ndarray  # text of each token
    pair: np.ndarray  # bigram of each token
    contexts: np.ndarray  # of each bigram, places in words
    successors: np.ndarray

    @staticmethod
    def of(docs: bytes, words: bytes, ranks: bytes) -> Batch:
        rows = np.frombuffer(docs, [("doc_id", "<i8"), ("null", "?"), ("train", "?"), ("count", "<i8")])
        own = restored(words, np.uint64)
        everything = np.unique(np.concatenate([own, [START, END]]))
        place = np.searchsorted(everything, own)
        start, end = np.searchsorted(everything, [START, END])
        count = rows["count"]
        ends = np.cumsum(count + 1) - 1
        token = np.full(int((count + 1).sum()), end, np.int64)
        inside = np.ones(len(token), bool)
        inside[ends] = False
        token[inside] = place[restored(ranks, np.uint32)]
        owner = np.repeat(np.arange(len(rows)), count + 1)
        before = np.empty(len(token), np.int64)
        before[1:] = token[:-1]
        before[np.concatenate([[0], ends[:-1] + 1])] = start
        keys, pair = np.unique(before * len(everything) + token, return_inverse=True)
        return Batch(rows, everything, token, owner, pair, keys // len(everything), keys % len(everything))

    def parts(self, shards: int, spread: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard the places of its words and of its bigrams, if it has any.

        A shard's words are those of its hash range and the contexts that are spread to it.
        """
        home = (self.words >> np.uint64(32)).astype(np.int64) % shards
        wide = np.isin(self.words, spread)
        mixed_pair = mixed(self.words[self.contexts] ^ mixed(self.words[self.successors])) >> np.uint64(32)
        shard = np.where(wide[self.contexts], mixed_pair.astype(np.int64) % shards, home[self.contexts])
        by_word, by_pair = np.argsort(home, kind="stable"), np.argsort(shard, kind="stable")
        word_cuts = np.searchsorted(home[by_word], np.arange(shards + 1))
        pair_cuts = np.searchsorted(shard[by_pair], np.arange(shards + 1))
        for s in np.union1d(home, shard).tolist():
            pairs = by_pair[pair_cuts[s] : pair_cuts[s + 1]]
            yield s, np.union1d(by_word[word_cuts[s] : word_cuts[s + 1]], self.contexts[pairs]), pairs

    def train_counts(self, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words that are not spread, and of bigrams."""
        train = self.docs["train"][self.owner]
        words = np.bincount(self.token[train], minlength=len(self.words))
        words[np.isin(self.words, spread)] = 0
        return words, np.bincount(self.pair[train], minlength=len(self.contexts))


def messages(shards: int, spread: np.ndarray):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, *stored in zip(frame["batch"], frame["docs"], frame["words"], frame["ranks"]):
                batch = Batch.of(*stored)
                word_counts, pair_counts = batch.train_counts(spread)
                out = []
                for s, own, pairs in batch.parts(shards, spread):
                    sizes = np.bincount(np.searchsorted(own, batch.contexts[pairs]), minlength=len(own))
                    out.append(
                        (
                            s,
                            name,
                            batch.words[own].tobytes(),
                            squeezed(word_counts[own].astype(np.uint32)),
                            squeezed(sizes.astype(np.uint32)),
                            shortened(batch.words[batch.successors[pairs]]),
                            squeezed(pair_counts[pairs].astype(np.uint32)),
                        )
                    )
                columns = [c.split()[0] for c in MESSAGE_SCHEMA.split(", ")]
                yield pd.DataFrame(out, columns=columns)

    return run


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key, for keys with a count."""
    some = counts > 0
    order = np.argsort(keys[some], kind="stable")
    keys, counts = keys[some][order], counts[some][order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def answered(shards: int, spread: np.ndarray, spread_totals: np.ndarray, prior: float):
    """One shard: sums, trie, and the answers to all batches."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        contexts = [np.frombuffer(c, np.uint64) for c in frame["contexts"]]
        sizes = [restored(c, np.uint32).astype(np.int64) for c in frame["sizes"]]
        successors = [lengthened(c) for c in frame["successors"]]
        word_counts = [restored(c, np.uint32).astype(np.int64) for c in frame["counts"]]
        pair_counts = np.concatenate([restored(c, np.uint32).astype(np.int64) for c in frame["pair_counts"]])
        known, total = summed(np.concatenate([*contexts, spread]), np.concatenate([*word_counts, spread_totals]))
        of_pair = np.concatenate([np.repeat(c, n) for c, n in zip(contexts, sizes)])
        follower = np.concatenate(successors)
        seen = pair_counts > 0
        vocabulary = np.unique(follower[seen])
        # Every context of a counted bigram has a count itself.
        key = np.searchsorted(known, of_pair[seen]).astype(np.uint64) * np.uint64(max(len(vocabulary), 1))
        keys, count = summed(key + np.searchsorted(vocabulary, follower[seen]).astype(np.uint64), pair_counts[seen])
        share = count / (total[(keys // np.uint64(max(len(vocabulary), 1))).astype(np.int64)] + prior)
        codes = quantised(share)
        own = (known >> np.uint64(32)).astype(np.int64) % shards == shard
        tokens = own & (known != START)
        out = []
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(folder, known, vocabulary, keys, codes)
            for name, words, size, after in zip(frame["batch"], contexts, sizes, successors):
                place = np.searchsorted(known, words)
                inside = np.minimum(place, max(len(known) - 1, 0))
                found = known[inside] == words if len(known) else np.zeros(len(words), bool)
                answer = np.where(found, total[inside], 0) if len(known) else np.zeros(len(words), np.int64)
                code = trie.lookup(np.repeat(words, size), after)
                out.append((name, shard, squeezed(answer), squeezed(code), int(total[tokens].sum()), int(tokens.sum())))
            del trie
        return pd.DataFrame(out, columns=[c.split()[0] for c in REPLY_SCHEMA.split(", ")])

    return run


def finished(shards: int, spread: np.ndarray, tokens: int, different: int, prior: float):
    """One batch and its answers: scores of its texts."""
    scale = tokens + different + 1.0

    def run(own: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        batch = Batch.of(*own[["docs", "words", "ranks"]].iloc[0])
        count = np.zeros(len(batch.words), np.int64)
        code = np.zeros(len(batch.contexts), np.uint16)
        answers = {s: (c, p) for s, c, p in zip(replies["shard"], replies["counts"], replies["codes"])}
        for s, words, pairs in batch.parts(shards, spread):
            counts, codes = answers[s]
            count[words] = restored(counts, np.int64)
            code[pairs] = restored(codes, np.uint16)
        single = (count + 1) / scale
        held = count[batch.contexts]
        share = np.where(code > 0, probability(code), 0.0)
        chance = share + prior / (held + prior) * single[batch.successors]
        number = len(batch.docs)
        known = count.copy()
        known[np.searchsorted(batch.words, START)] = 0
        add = lambda values: np.bincount(batch.owner, weights=values, minlength=number)
        out = pd.DataFrame(
            {
                "doc_id": pd.array(batch.docs["doc_id"], dtype="Int64"),
                "held_out": ~batch.docs["train"],
                "n_tokens": batch.docs["count"] + 1,
                "n_known": add((known > 0)[batch.token]).astype(np.int64),
                "base_score": add(np.log10(single)[batch.token]),
                "score": add(np.log10(chance)[batch.pair]),
            }
        )
        out.loc[batch.docs["null"], "doc_id"] = pd.NA
        return out

    return run


def sample_counts(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        words, counts = np.unique(words_of(frame["text"].tolist()).hashes, return_counts=True)
        yield pd.DataFrame({"word": words.view(np.int64), "uses": counts})


def frequent_words(rows: DataFrame, total: int) -> np.ndarray:
    """Words to spread over shards, from a sample; they change where counts meet, not the counts."""
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    drawn = F.pmod(F.xxhash64("text", F.lit("words")), F.lit(1 << 31)) < int(share * (1 << 31))
    uses = checkpointed(
        rows.filter(drawn).select("text").distinct()
        .mapInPandas(sample_counts, "word long, uses long").groupBy("word").agg(F.sum("uses").alias("uses"))
    )
    all_uses = uses.agg(F.sum("uses")).first()[0] or 0
    found = uses.filter(F.col("uses") >= FREQUENT * all_uses).collect()
    words = np.sort(np.array([r["word"] for r in found], np.int64).view(np.uint64))
    return np.union1d(words, [START]).astype(np.uint64)


def scored(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) by the model of its training rows."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), (fold() != HELD_FOLD).alias("train")
    )
    spread = frequent_words(rows, rows.count())
    stored = checkpointed(rows.mapInPandas(batches(spread), BATCH_SCHEMA))
    everything = stored.agg(F.sum("tokens")).first()[0] or 0
    sums = stored.select(F.posexplode("spread_counts")).groupBy("pos").agg(F.sum("col").alias("uses")).collect()
    totals = np.zeros(len(spread), np.int64)
    for row in sums:
        totals[row["pos"]] = row["uses"]
    shards = max(1, -(-everything // SHARD_TOKENS))
    replies = checkpointed(
        stored.mapInPandas(messages(shards, spread), MESSAGE_SCHEMA)
        .groupBy("shard")
        .applyInPandas(answered(shards, spread, totals, prior), REPLY_SCHEMA)
    )
    release(rows.sparkSession)
    sums = replies.groupBy("shard").agg(F.max("shard_tokens").alias("n"), F.max("shard_words").alias("v"))
    tokens, different = (x or 0 for x in sums.agg(F.sum("n"), F.sum("v")).first())
    # Names differ between the sides, as both come from the same batches.
    answers = replies.select(F.col("batch").alias("to_batch"), "shard", "counts", "codes").groupBy("to_batch")
    scores = stored.groupBy("batch").cogroup(answers).applyInPandas(
        finished(shards, spread, tokens, different, prior), SCORE_SCHEMA
    )
    return scores.withColumn("train_tokens", F.lit(tokens).cast("long"))

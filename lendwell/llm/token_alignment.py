"""Alignment of two tokenizers' tokens by their end positions, along diagonals.

A text is encoded by a byte-level BPE (A, of a space and the text; parts of Latin letters by the faster of two
libraries, which is given the same file) and by a SentencePiece model (B,
which adds that space). Both lists of tokens spell the same bytes, so tokens are told by where they
end. ``walk`` compares the two ascending lists of ends at the current shift between their indexes:
slices of 1, 2, 4, … ends as long as they are equal, then back by halves to the first difference; such a
stretch is one to one. At a difference the list that lags is advanced until both end together: an
irregular group, after which the shift is new. Tokens of a group that overlap are linked.

1. Batches: texts are cut before spaces that follow no white space, where neither tokenizer has a token
   across; each different part is encoded once per worker. The walk goes over whole texts, one after the
   other. A text's digest, counts and its pairs of linked ids with their number go to a table in the
   shared folder.
2. Pairs are counted over all texts; a pair is best if no pair of its B id has a higher count.
3. Texts look up their pairs: the ``FREQUENT`` most frequent ones are sent to every task; only pairs
   beyond them, if there are so many, are joined by a shuffle, text and pair a row. Those are rare pairs,
   so no key is large.

Cases: null and empty texts, and texts that A or B does not spell byte for byte (such as texts with the
marker U+2581), have no tokens, zeros and an empty digest; special tokens' names are plain text; very
long texts are walked in blocks of about ``BLOCK_CHARS`` between parts, a part without a space as a whole;
repeated rows each count and give a row; null ids give rows; without rows nothing comes out; other
columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lendwell.llm.common import text_of
from lendwell.session import scratch_path

BYTE_FILE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
# Characters walked at once, and parts whose ids a worker process keeps.
BLOCK_CHARS, KNOWN_PARTS = 256 << 10, 100_000
# Rows that are taken out of an Arrow batch at once.
ROWS = 250
# Pairs, the most frequent ones, that are sent to every task.
FREQUENT = 1_000_000
SPACE = "▁"
# Fixed value: how the byte-level BPE cuts a text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Parts of Latin letters and older signs only, which do not end with white space; as many are encoded as one text.
SETTLED = re.compile(r"[\x00-\u024f]*[^\s\u0250-\U0010ffff]")
JOINED = 2_000
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
# White space before a space: such texts are cut by CUT, others at every space.
LOOSE, CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


def byte_of() -> dict[str, int]:
    """Byte of each character of byte-level entries: printable Latin-1 stands for itself, others follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def byte_entry(entry: str, table: dict[str, int]) -> bytes:
    """An entry that is not byte-level, such as a special token's, is its own text."""
    return bytes(table[c] for c in entry) if all(c in table for c in entry) else entry.encode()


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    match = BYTE_PIECE.fullmatch(piece) if is_byte else None
    return bytes([int(match[1], 16)]) if match else piece.replace(SPACE, " ").encode()


@dataclass
class Vocabulary:
    spelled: list[bytes]
    lengths: np.ndarray = field(init=False)
    digits: np.ndarray = field(init=False)  # decimal ids, right-aligned, zeros before them

    def __post_init__(self) -> None:
        self.lengths = np.array([len(s) for s in self.spelled], np.int64)
        ids = np.arange(len(self.spelled))
        width = len(str(max(len(ids) - 1, 0)))
        powers = 10 ** np.arange(width - 1, -1, -1)
        self.digits = np.where((ids[:, None] >= powers) | (powers == 1), ids[:, None] // powers % 10 + ord("0"), 0).astype(np.uint8)


def ranked(byte_model: str, table: dict[str, int]) -> tiktoken.Encoding | None:
    """The byte-level BPE for a faster library, which merges the pair of the least id first.

    None unless ids rise with the order of the model's merges, so that both choose alike.
    """
    model = json.loads(byte_model)["model"]
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary["".join(m)] for m in merges]
    if any(x >= y for x, y in zip(made, made[1:])) or set(vocabulary.values()) - set(made) != {vocabulary[c] for c in table}:
        return None
    ranks = {byte_entry(entry, table): rank for entry, rank in vocabulary.items()}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Coders:
    """Both tokenizers, their vocabularies, and the ids of parts met before."""

    def __init__(self, byte_model: str, piece_model: bytes):
        self.a = Tokenizer.from_str(byte_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        table = byte_of()
        self.fast = ranked(byte_model, table)
        self.of_a = Vocabulary([byte_entry(self.a.id_to_token(i) or "", table) for i in range(self.a.get_vocab_size())])
        self.of_b = Vocabulary([piece_bytes(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())])
        # A part without its first space: ids of A and B as bytes; and parts that are not spelled alike
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.odd: set[str] = set()

    def learn(self, parts: set[str]) -> None:
        if len(self.known) > KNOWN_PARTS:
            # Frequent parts are among these, too; the others make room.
            self.known = {part: self.known[part] for part in parts if part in self.known}
            self.odd &= parts
        new = [p for p in parts if p not in self.known]
        # Letters that every library knows as such, no white space at the end: such parts go in one text.
        joined = [p for p in new if self.fast and SETTLED.fullmatch(p)]
        for start in range(0, len(joined), JOINED):
            self.learn_joined(joined[start : start + JOINED])
        self.learn_alone([p for p in new if p not in self.known])

    def learn_joined(self, parts: list[str]) -> None:
        own = [f" {p}".encode() for p in parts]
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(parts)), np.uint32)
        ends = np.cumsum([len(o) for o in own])
        cuts = np.searchsorted(np.cumsum(self.of_a.lengths[ids]), ends) + 1
        data = ids.tobytes()
        a = [data[4 * x : 4 * y] for x, y in zip([0, *cuts.tolist()], cuts.tolist())]
        b = self.b.encode(parts, num_threads=1)
        # No token goes beyond a part, so the whole tells; odd parts are then looked for one by one.
        if self.spelled(ids.tolist(), self.of_a) != b"".join(own):
            return self.learn_alone(parts)
        self.known.update(zip(parts, zip(a, [array("I", x).tobytes() for x in b])))
        self.find_odd(parts, b, self.of_b, own)

    def learn_alone(self, parts: list[str]) -> None:
        spaced = [f" {p}" for p in parts]
        a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        # The model gives an empty text no marker, but a text that ends with a space has one there.
        b = [ids or [self.b.piece_to_id(SPACE)] for ids in self.b.encode(parts, num_threads=1)]
        self.known.update(zip(parts, zip([array("I", x).tobytes() for x in a], [array("I", x).tobytes() for x in b])))
        own = [p.encode() for p in spaced]
        self.find_odd(parts, a, self.of_a, own)
        self.find_odd(parts, b, self.of_b, own)

    def find_odd(self, parts: list[str], ids: list[list[int]], of: Vocabulary, own: list[bytes]) -> None:
        """Note parts that are not spelled byte for byte; lengths and all parts joined tell if there are any."""
        flat = list(chain.from_iterable(ids))
        ends = np.cumsum([len(x) for x in ids], dtype=np.int64) - 1
        reached = np.cumsum(of.lengths[flat])[ends] if flat else np.zeros(0)
        if not (np.array_equal(reached, np.cumsum([len(o) for o in own])) and self.spelled(flat, of) == b"".join(own)):
            self.odd.update(p for p, x, o in zip(parts, ids, own) if self.spelled(x, of) != o)

    @staticmethod
    def spelled(ids: Iterable[int], of: Vocabulary) -> bytes:
        spelled = of.spelled
        return b"".join([spelled[i] for i in ids])

    def spells(self, text: str, parts: list[str]) -> bool:
        """Whether both lists of tokens spell a space and the text."""
        if self.odd.isdisjoint(parts):
            return True
        a, b = (np.frombuffer(b"".join([self.known[p][k] for p in parts]), np.uint32).tolist() for k in (0, 1))
        own = f" {text}".encode()
        return self.spelled(a, self.of_a) == own and self.spelled(b, self.of_b) == own


@lru_cache(maxsize=2)
def coders(byte_model: str, piece_model: bytes) -> Coders:
    """Made once per worker process."""
    return Coders(byte_model, piece_model)


def parts_of(text: str) -> list[str]:
    """The text and a space before it, cut before spaces that follow no white space; without that space."""
    if LOOSE.search(f" {text}"):
        return [p[1:] for p in CUT.split(f" {text}")]
    return text.split(" ")


def walk(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each group of two ascending lists of ends with the same last end: the tokens after it."""
    run_a: list[int] = []
    run_b: list[int] = []
    run_size: list[int] = []
    odd_a: list[int] = []
    odd_b: list[int] = []
    i = j = 0
    count = len(a)
    while i < count:
        if a[i] == b[j]:
            first = i
            run_a.append(i)
            run_b.append(j)
            # The shift j - i holds: equal slices twice as long each time, then back by halves.
            i, j, step = i + 1, j + 1, 2
            while i < count and a[i : i + step] == b[j : j + step]:
                i, j, step = i + step, j + step, 2 * step
            if i >= count:
                run_size.append(count - first)
                break
            while step > 1:
                step >>= 1
                if a[i : i + step] == b[j : j + step]:
                    i, j = i + step, j + step
            run_size.append(i - first)
        # The list that lags goes on until both end together; the shift is new then.
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        odd_a.append(i)
        odd_b.append(j)
    sizes = np.array(run_size, np.int64)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    past_a = np.concatenate([np.repeat(np.array(run_a, np.int64), sizes) + within, np.array(odd_a, np.int64)])
    past_b = np.concatenate([np.repeat(np.array(run_b, np.int64), sizes) + within, np.array(odd_b, np.int64)])
    order = np.argsort(past_a, kind="stable")
    return past_a[order], past_b[order]


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens that overlap, in order, from their ends."""
    first = np.searchsorted(b, np.concatenate([[0], a[:-1]]), side="right")
    number = np.searchsorted(b, a, side="left") - first + 1
    token = np.repeat(np.arange(len(a)), number)
    return token, np.arange(len(token)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)


def written(ids_a: np.ndarray, ids_b: np.ndarray, past_a: np.ndarray, past_b: np.ndarray, of_a: Vocabulary, of_b: Vocabulary):
    """``a1,a2|b1;…;`` of all groups as bytes, and the offset of each token's end by its place."""
    at_a, at_b = np.arange(len(ids_a)), np.arange(len(ids_b))
    begins_b = np.concatenate([[0], past_b[:-1]])
    place_a = at_a + begins_b[np.searchsorted(past_a, at_a, side="right")]
    place_b = at_b + past_a[np.searchsorted(past_b, at_b, side="right")]
    wide_a, wide_b = of_a.digits.shape[1], of_b.digits.shape[1]
    width = max(wide_a, wide_b)
    cells = np.zeros((len(ids_a) + len(ids_b), width + 1), np.uint8)
    cells[place_a, width - wide_a : width] = of_a.digits[ids_a]
    cells[place_b, width - wide_b : width] = of_b.digits[ids_b]
    cells[:, width] = ord(",")
    cells[place_a[past_a - 1], width] = ord("|")
    cells[place_b[past_b - 1], width] = ord(";")
    used = cells != 0
    return cells[used].tobytes(), np.concatenate([[0], np.cumsum(used.sum(axis=1))])


@dataclass
class Open:
    """What is known of a text while its blocks are walked."""

    row: int
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    digest: object = field(default_factory=hashlib.sha256)
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)


class Aligner:
    """Aligns texts block by block."""

    def __init__(self, byte_model: str, piece_model: bytes):
        self.coders = coders(byte_model, piece_model)

    def block(self, texts: list[tuple[Open, list[str]]]) -> None:
        """Walk over the parts of several texts, or of one stretch of a long text, and add up."""
        known, of_a, of_b = self.coders.known, self.coders.of_a, self.coders.of_b
        lists = [[known[p] for p in parts] for _, parts in texts]
        joined_a = [b"".join([k[0] for k in ids]) for ids in lists]
        joined_b = [b"".join([k[1] for k in ids]) for ids in lists]
        ids_a = np.frombuffer(b"".join(joined_a), np.uint32).astype(np.int64)
        ids_b = np.frombuffer(b"".join(joined_b), np.uint32).astype(np.int64)
        if not len(ids_a):
            return
        ends_a, ends_b = np.cumsum(of_a.lengths[ids_a]), np.cumsum(of_b.lengths[ids_b])
        past_a, past_b = walk(ends_a.tolist(), ends_b.tolist())
        link_a, link_b = links(ends_a, ends_b)
        text, offsets = written(ids_a, ids_b, past_a, past_b, of_a, of_b)
        # Where each text's tokens, groups and links end
        end_a, end_b = np.cumsum([len(j) // 4 for j in joined_a]), np.cumsum([len(j) // 4 for j in joined_b])
        group = np.searchsorted(past_a, end_a, side="right")
        link = np.searchsorted(link_a, end_a, side="left")
        span = len(of_a.spelled) * len(of_b.spelled)
        owner = np.searchsorted(end_a, link_a, side="right")
        key = np.sort(owner * span + ids_a[link_a] * len(of_b.spelled) + ids_b[link_b])
        new = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        times = np.diff(np.append(new, len(key)))
        pair = key[new] % span
        cut = np.searchsorted(key[new], np.arange(len(texts) + 1) * span)
        a = b = g = n = 0
        for k, (state, _) in enumerate(texts):
            own = text[offsets[a + b] : offsets[end_a[k] + end_b[k]]]
            if own:
                state.digest.update((b";" if state.n_a else b"") + own[:-1])
            state.n_a += int(end_a[k] - a)
            state.n_b += int(end_b[k] - b)
            state.n_groups += int(group[k] - g)
            state.n_links += int(link[k] - n)
            state.pairs.append(pair[cut[k] : cut[k + 1]])
            state.times.append(times[cut[k] : cut[k + 1]])
            a, b, g, n = end_a[k], end_b[k], group[k], link[k]

    def __call__(self, texts: list[str]) -> Iterator[list[Open]]:
        """Finished texts, in order, some at a time."""
        chunk: list[tuple[Open, str]] = []
        size = 0
        for row, text in enumerate(texts):
            chunk.append((Open(row), text))
            size += len(text)
            if size >= BLOCK_CHARS:
                yield self.finished(chunk)
                chunk, size = [], 0
        yield self.finished(chunk)

    def finished(self, chunk: list[tuple[Open, str]]) -> list[Open]:
        cut = [(state, text, parts_of(text)) for state, text in chunk if text]
        self.coders.learn(set().union(*[parts for _, _, parts in cut]))
        batch: list[tuple[Open, list[str]]] = []
        size = 0
        for state, text, parts in cut:
            if not self.coders.spells(text, parts):
                continue
            for stretch in self.stretches(parts):
                batch.append((state, stretch))
                size += sum(map(len, stretch)) + len(stretch)
                if size >= BLOCK_CHARS:
                    self.block(batch)
                    batch, size = [], 0
        self.block(batch)
        return [state for state, _ in chunk]

    @staticmethod
    def stretches(parts: list[str]) -> Iterator[list[str]]:
        """Parts of one text in stretches of about a block."""
        start = size = 0
        for at, part in enumerate(parts):
            size += len(part) + 1
            if size >= BLOCK_CHARS:
                yield parts[start : at + 1]
                start, size = at + 1, 0
        if start < len(parts):
            yield parts[start:]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(ends, pa.array(flat.astype(kind)))


def aligner(byte_model: str, piece_model: bytes):
    """Arrow batches of ``doc_id, text`` to counts, digests and pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        align = Aligner(byte_model, piece_model)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for done in align(batch["text"].to_pylist()):
                if not done:
                    continue
                joined = [np.concatenate(s.pairs) if s.pairs else np.zeros(0) for s in done]
                times = [np.concatenate(s.times) if s.times else np.zeros(0) for s in done]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(done[0].row, len(done)),
                        *(pa.array([getattr(s, n) for s in done], pa.int64()) for n in NUMBERS),
                        pa.array([s.digest.hexdigest() if s.n_a else "" for s in done], pa.string()),
                        lists(joined, np.int64),
                        lists(times, np.int32),
                    ],
                    names=["doc_id", *NUMBERS, "groups_sha256", "pairs", "times"],
                )

    return run


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def aligned(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """Counts, digest of the groups, and different linked pairs with their number, for every row.

    A pair is ``a * pieces + b``, ``pieces`` being the number of pieces of B.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(aligner(file_text(byte_file), file_bytes(piece_file)), ALIGNED)


def counted_pairs(texts: DataFrame, pieces: int) -> DataFrame:
    """``pair, links, best``: how many links hold a pair, and whether no pair of its B id has more."""
    pairs = (
        texts.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair"))
        .agg(F.sum("p.times").alias("links"))
    )
    most = pairs.groupBy(F.pmod("pair", F.lit(pieces)).alias("b")).agg(F.max("links").alias("most"))
    # One row for each piece of the model at most
    return pairs.join(F.broadcast(most), F.pmod("pair", F.lit(pieces)) == F.col("b")).select(
        "pair", "links", (F.col("links") == F.col("most")).alias("best")
    )


@dataclass
class Lookup:
    pairs: np.ndarray  # ascending
    links: np.ndarray
    best: np.ndarray


def looked_up(table: Broadcast, with_rest: bool):
    """Lists of pairs and their numbers to sums over the known ones, and the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Lookup = table.value
        for batch in batches:
            pairs, times = batch["pairs"], batch["times"]
            ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            flat = pairs.flatten().to_numpy(zero_copy_only=False)
            number = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(known.pairs, flat), max(len(known.pairs) - 1, 0))
            there = known.pairs[at] == flat if len(known.pairs) else np.zeros(len(flat), bool)
            best = np.where(there, known.best[at] * number, 0) if len(known.pairs) else number * 0
            links = np.where(there, known.links[at] * number, 0) if len(known.pairs) else number * 0
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[ends]) for v in (best, links)]
            columns = [*(batch[c] for c in batch.schema.names if c not in ("pairs", "times")), pa.array(sums[0]), pa.array(sums[1])]
            names = [c for c in batch.schema.names if c not in ("pairs", "times")] + ["n_best", "count_sum"]
            if with_rest:
                cut = np.concatenate([[0], np.cumsum(~there)])[ends].astype(np.int32)
                columns += [pa.ListArray.from_arrays(cut, pa.array(v[~there])) for v in (flat, number)]
                names += ["rest", "rest_times"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def compared(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE, frequent: int = FREQUENT) -> DataFrame:
    """Counts of tokens, groups and links of every row, and how common its linked pairs are in all rows."""
    spark = docs.sparkSession
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()
    path, counts = scratch_path(spark, "alignment"), scratch_path(spark, "alignment-pairs")
    aligned(docs, byte_file, piece_file).write.parquet(path)
    texts = spark.read.parquet(path)
    counted_pairs(texts, pieces).write.parquet(counts)
    pairs = spark.read.parquet(counts)
    top, rest = most_frequent(pairs, frequent)
    got = top.toArrow()
    order = np.argsort(got["pair"].to_numpy())
    table = spark.sparkContext.broadcast(Lookup(*(got[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "links", "best"))))
    if rest is None:
        return texts.mapInArrow(looked_up(table, False), OUT).select(*RESULT)
    return with_rare(texts, rest, table)


def most_frequent(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """At most so many of the most frequent pairs, and the others, if any; cut by quarters of an octave."""
    octave = F.floor(F.log2("links") * 4)
    number = dict(pairs.groupBy(octave.alias("o")).count().collect())
    kept, held = max(number, default=0) + 1, 0
    for key in sorted(number, reverse=True):
        held += number[key]
        if held > most:
            return pairs.filter(octave >= kept), pairs.filter(octave < kept)
        kept = key
    return pairs, None


def with_rare(texts: DataFrame, pairs: DataFrame, table: Broadcast) -> DataFrame:
    """As the plain lookup, with the rare pairs, which were not sent, joined by a shuffle."""
    path = scratch_path(texts.sparkSession, "alignment-rest")
    found = texts.mapInArrow(looked_up(table, True), f"{OUT}, rest array<long>, rest_times array<long>")
    # Numbered and written, so that a repeated task finds the same numbers.
    found.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = texts.sparkSession.read.parquet(path)
    rest = rows.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("p")).select(
        "row", F.col("p.rest").alias("pair"), F.col("p.rest_times").alias("n")
    )
    sums = rest.join(pairs, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum")
    )

    def plus(column: str, more: str) -> Column:
        return (F.col(column) + F.coalesce(F.col(more), F.lit(0))).alias(column)

    return rows.join(sums, "row", "left").withColumns(
        {"n_best": plus("n_best", "more_best"), "count_sum": plus("count_sum", "more_sum")}
    ).select(*RESULT)

"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protocol buffer wire format) and rebuilt as a tokenizer: the
normaliser with its character map, dummy prefix and white-space rules, the marker for spaces,
merges ranked by piece score (BPE models) or scored pieces (unigram models), and byte
fallback. No piece of a model may hold the marker after another character; this is checked,
and lets a text be cut before its spaces. Batches are encoded by the library's own threads.

Parity: every different part is also encoded by the sentencepiece library; ``parity`` says that
all parts of a text agree. ``restored`` says that decoding the ids gives the text again, also by
parts. Both hold for parts: the query compares no text as a whole; a test does.

Cases: a null or empty text has no ids; a text with the marker character itself or, for models
that change white space, with such white space is encoded and not restored; very long texts go
through alone; repeated rows each give a row; other columns do not matter.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from lendwell.llm.common import give_back, text_of

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_CHARS = 4 << 20
THREADS = 2
MARK = "▁"
SPACED = re.compile(r" +[^ ]*")
# Parts whose ids a worker process keeps between batches, and parts that it encodes at once.
KNOWN_PARTS, NEW_PARTS = 300_000, 20_000
# The same where memory is short: half the memory of a worker for about a seventh more time.
FEW_KNOWN, FEW_NEW = 150_000, 4_000
# Rows that are taken out of an Arrow batch at once.
ROWS = 1_000

# Field numbers and codes of the model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class PieceModel:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    character_map: bytes
    dummy_prefix: bool
    trim_spaces: bool

    @property
    def unknown(self) -> int | None:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            length, at = varint(at)
            value, at = data[at : at + length], at + length
        elif wire in (1, 5):
            length = 8 if wire == 1 else 4
            value, at = data[at : at + length], at + length
        else:
            raise ValueError(f"wire type {wire} in a model file")
        yield tag >> 3, value


def parsed(data: bytes) -> PieceModel:
    pieces: list[tuple[str, float, int]] = []
    trainer: dict[int, int | bytes] = {}
    rules: dict[int, int | bytes] = {}
    for number, value in fields(data):
        if number == PIECES:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            rules = dict(fields(value))
    if trainer.get(24, 0):
        raise ValueError("models with the space marker as a suffix are not supported")
    if any(kind == USER_DEFINED for _, _, kind in pieces):
        raise ValueError("user-defined pieces are not supported")
    if any(MARK in piece.lstrip(MARK) for piece, _, _ in pieces):
        raise ValueError("a piece goes beyond a space")
    return PieceModel(
        pieces,
        kind=trainer.get(3, UNIGRAM),
        byte_fallback=bool(trainer.get(35, 0)),
        character_map=rules.get(2, b""),
        dummy_prefix=bool(rules.get(3, 1)),
        trim_spaces=bool(rules.get(4, 1)),
    )


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first."""
    known = {piece: score for piece, score, kind in model.pieces if kind == NORMAL}
    found = [
        (score, piece[:cut], piece[cut:])
        for piece, score in known.items()
        for cut in range(1, len(piece))
        if piece[:cut] in known and piece[cut:] in known
    ]
    found.sort(key=lambda m: -m[0])
    return [(left, right) for _, left, right in found]


def rebuilt(model: PieceModel) -> Tokenizer:
    if model.kind == BPE:
        core = models.BPE(
            {piece: i for i, (piece, _, _) in enumerate(model.pieces)},
            merges(model),
            unk_token=None if model.unknown is None else model.pieces[model.unknown][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    elif model.kind == UNIGRAM:
        core = models.Unigram([p[:2] for p in model.pieces], model.unknown, model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is not supported")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.character_map)] if model.character_map else []
    if model.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+"), "merged_with_next")
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tokenizer


@lru_cache(maxsize=2)
def loaded(data: bytes) -> tuple[Tokenizer, sentencepiece.SentencePieceProcessor]:
    """Both libraries' forms of a model, made once per worker process."""
    return rebuilt(parsed(data)), sentencepiece.SentencePieceProcessor(model_proto=data)


def use_threads(threads: int) -> None:
    """Threads of encode_batch; they are fixed when a worker process first encodes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)


class Encoder:
    """Encodes texts part by part, each different part of a batch once, and checks the parts.

    A part is a run of spaces and what follows up to the next space; no piece goes beyond
    it, so the ids of a text are those of its parts in order. Models that change characters or
    trim spaces, and texts that hold the marker itself, are encoded whole.
    """

    def __init__(self, data: bytes, short_of_memory: bool = False):
        self.most_known, self.most_new = (FEW_KNOWN, FEW_NEW) if short_of_memory else (KNOWN_PARTS, NEW_PARTS)
        self.tokenizer, self.processor = loaded(data)
        model = parsed(data)
        self.in_parts = model.dummy_prefix and not model.trim_spaces and not model.character_map
        self.marker = self.tokenizer.token_to_id(MARK)
        self.in_parts = self.in_parts and self.marker is not None
        # Ids of a part as bytes; parts that decoding does not give again, and those the libraries differ on
        self.known: dict[str, bytes] = {}
        self.unlike: set[str] = set()
        self.unequal: set[str] = set()

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.in_parts or MARK in text:
            return [text]
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [run[1:] for run in SPACED.findall(f" {text}")]
        return text.split(" ")

    def learn(self, parts: set[str]) -> None:
        if len(self.known) > self.most_known:
            # Frequent parts are in this batch, too; the others make room.
            self.known = {part: self.known[part] for part in parts if part in self.known}
            self.unlike &= parts
            self.unequal &= parts
        new = [part for part in parts if part not in self.known]
        for start in range(0, len(new), self.most_new):
            some = new[start : start + self.most_new]
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            theirs = self.processor.encode(some, num_threads=1)
            restored = self.tokenizer.decode_batch(ours, skip_special_tokens=False)
            self.known.update(zip(some, [array("i", ids).tobytes() for ids in ours]))
            if restored != some:
                self.unlike.update(part for part, again in zip(some, restored) if part != again)
            if theirs != ours:
                self.unequal.update(part for part, ids, other in zip(some, ours, theirs) if ids != other)
        # Nothing after the last space of a text: the marker alone.
        if self.marker is not None:
            self.known[""] = array("i", [self.marker]).tobytes()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool], list[bool]]:
        """All ids in one array, the texts' ends in it, and both checks per text."""
        # Texts are cut twice: the parts of a whole batch would take ten times the memory of its text.
        different: set[str] = set()
        for text in texts:
            different.update(self.parts(text))
        self.learn(different)
        known, ids, ends, restored, parity = self.known, bytearray(), [0], [], []
        for text in texts:
            parts = self.parts(text)
            ids += b"".join(map(known.__getitem__, parts))
            ends.append(len(ids) // 4)
            restored.append(not self.unlike or self.unlike.isdisjoint(parts))
            parity.append(not self.unequal or self.unequal.isdisjoint(parts))
        return np.frombuffer(ids, np.int32), np.array(ends, np.int32), restored, parity


def pieces_of(columns: pa.Table, most: int) -> Iterator[pa.Table]:
    """Slices of about so many bytes of text; a longer text is alone in its slice."""
    ends = np.cumsum([len(t) for t in columns["text"].to_pylist()])
    start, before = 0, 0
    for at, end in enumerate(ends):
        if at + 1 == len(ends) or ends[at + 1] - before > most:
            yield columns.slice(start, at + 1 - start)
            start, before = at + 1, end


def encoded_batches(encode: Encoder, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        for piece in pieces_of(pa.Table.from_batches([batch]), BATCH_CHARS):
            flat, ends, restored, parity = encode(piece["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    piece["doc_id"].combine_chunks(),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.ListArray.from_arrays(ends, flat),
                    pa.array(restored),
                    pa.array(parity),
                ],
                names=["doc_id", "n_tokens", "ids", "restored", "parity"],
            )


def encoder(data: bytes, threads: int, short_of_memory: bool = False):
    """Arrow batches of ``doc_id, text`` to ids and checks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_threads(threads)
        yield from encoded_batches(Encoder(data, short_of_memory), batches)
        give_back()

    return run


def decoder(data: bytes, threads: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_threads(threads)
        tokenizer, _ = loaded(data)
        for batch in batches:
            texts = tokenizer.decode_batch(
                [ids or [] for ids in batch["ids"].to_pylist()], skip_special_tokens=False
            )
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def model_bytes(path: str) -> bytes:
    """The model as read by the driver; it goes to the executors with the function."""
    with open(path, "rb") as file:
        return file.read()


def encoded(
    docs: DataFrame, model_file: str = MODEL_FILE, threads: int = THREADS, short_of_memory: bool = False
) -> DataFrame:
    """``doc_id, n_tokens, ids, restored, parity`` for every row of ``docs`` (doc_id, text).

    ``short_of_memory`` keeps fewer parts between batches, for the same rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    schema = "doc_id long, n_tokens long, ids array<int>, restored boolean, parity boolean"
    return rows.mapInArrow(encoder(model_bytes(model_file), threads, short_of_memory), schema)


def decoded(rows: DataFrame, model_file: str = MODEL_FILE, threads: int = THREADS) -> DataFrame:
    """``doc_id, text`` from rows of ``doc_id, ids``; null ids give an empty text."""
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return own.mapInArrow(decoder(model_bytes(model_file), threads), "doc_id long, text string")

"""Benchmark decontamination: a hash set of test windows goes to every task, training texts are scanned for it.

Texts are lower-cased (A-Z) and cut into words: runs of ASCII letters, digits and any other
characters beyond ASCII. A window is ``WINDOW`` consecutive words of a benchmark item; an item with
fewer words, but not none, is one window. Windows become 64-bit hashes. A task hashes the windows of
whole texts from prefix sums, looks them up, and compares the words of every hit with the item's own
words. Words inside a confirmed window are hit; ``cleaned`` cuts them out or drops the document.

The hash set goes to the tasks only as far as ``SET_WINDOWS`` windows and ``SET_BYTES`` bytes allow: a
larger benchmark is dealt by hash into slices of that size, texts are scanned once per slice, and the
hit words of a text are put together by a shuffle of the texts that are hit. Long items are cut into
segments that share all but one word of a window, so that slices stay even. No text is shuffled.

Cases: null and empty texts, and texts without words, have no words and no hits; items without words
have no window; an item with a null id marks words, but is neither counted nor listed; items that
share an id count once; repeated documents each give a row, null ids too; very long texts are scanned
whole, alone in their batch; without items nothing is hit, without documents there are no rows; other
columns do not matter, and ``cleaned`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell.llm.common import by_bytes, text_of
from lendwell.llm.words import ALNUM, mixed, powers

WINDOW = 10
# Windows and bytes of text that one slice of the benchmark may bring to every task.
SET_WINDOWS, SET_BYTES = 1_000_000, 24 << 20
# Words of a segment of a long item.
SEGMENT = 10_000
# Characters of a piece of work.
BATCH_CHARS = 512 << 10
FILTER_BITS = 20
# Characters that are no part of a word, as Java and as DuckDB write them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = 32


@dataclass
class Located:
    """Words of several texts: hashes, places, and the words parted by single spaces."""

    hashes: np.ndarray
    docs: np.ndarray  # the text of each word, ascending
    counts: np.ndarray  # words of each text
    starts: np.ndarray  # byte in ``raw`` at which a word starts
    ends: np.ndarray
    plain: bytes  # all words in lower case, a space after each
    offsets: np.ndarray  # of each word in ``plain``, and the end
    raw: np.ndarray  # bytes of all texts, a space after each
    limits: np.ndarray  # of each text in ``raw``, and the end


def located(texts: list[str | None]) -> Located:
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(encoded) + b" ", np.uint8)
    low = ALNUM[raw]
    letter = low != 0
    edges = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(1 << max(19, len(raw).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * up[: len(low)], dtype=np.uint64)])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    limits = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])]).astype(np.int64)
    docs = np.searchsorted(limits[1:], starts, side="right")
    kept = letter.copy()
    kept[ends] = True
    plain = np.where(letter, low, SPACE)[kept].astype(np.uint8).tobytes()
    offsets = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    counts = np.bincount(docs, minlength=len(texts))
    return Located(hashes, docs, counts, starts, ends, plain, offsets, raw, limits)


def window_hashes(words: Located, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of so many words that lie in one text, and their hashes."""
    count = len(words.hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.flatnonzero(words.docs[:count] == words.docs[size - 1 :])
    up, down = powers(1 << max(19, len(words.hashes).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes * up[: len(words.hashes)], dtype=np.uint64)])
    return inside, mixed((sums[inside + size] - sums[inside]) * down[inside] + np.uint64(size))


@dataclass
class TestSet:
    """Different windows of one slice of the benchmark, by the hash of their words."""

    sizes: list[int]  # of windows, in words
    hashes: np.ndarray  # ascending; different windows of one hash follow each other
    texts: list[slice]  # of each window in ``plain``
    plain: bytes
    items: list[str]  # ids as text, ascending
    first: np.ndarray  # of a window's entries in ``of``, and the end
    of: np.ndarray  # places in ``items``
    known: np.ndarray  # bit per value of a hash's first FILTER_BITS bits


def test_set(ids: list[str | None], texts: list[str], window: int) -> TestSet:
    """The windows of items or segments of items."""
    words = located(texts)
    sizes = sorted({min(window, int(n)) for n in words.counts if n})
    names = sorted({i for i in ids if i is not None})
    place = {name: at for at, name in enumerate(names)}
    owner = np.array([place.get(i, -1) for i in ids], np.int64)
    found: dict[tuple[int, bytes], list[int]] = {}
    spot: dict[tuple[int, bytes], slice] = {}
    for size in sizes:
        starts, hashes = window_hashes(words, size)
        docs = words.docs[starts]
        due = words.counts[docs] == size if size < window else words.counts[docs] >= window
        for at, code, doc in zip(starts[due].tolist(), hashes[due].tolist(), docs[due].tolist()):
            part = slice(int(words.offsets[at]), int(words.offsets[at + size]))
            key = (code, words.plain[part])
            spot.setdefault(key, part)
            found.setdefault(key, []).append(int(owner[doc]))
    keys = sorted(found)
    lists = [sorted(set(found[k]) - {-1}) for k in keys]
    hashes = np.array([k[0] for k in keys], np.uint64)
    known = np.zeros(1 << FILTER_BITS, bool)
    known[hashes >> np.uint64(64 - FILTER_BITS)] = True
    return TestSet(
        sizes,
        hashes,
        [spot[k] for k in keys],
        words.plain,
        names,
        np.cumsum([0, *map(len, lists)]),
        np.array([i for part in lists for i in part], np.int64),
        known,
    )


def confirmed(words: Located, tests: TestSet) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Which words lie in an occurrence of a window, and the items met, by text."""
    steps = np.zeros(len(words.hashes) + 1, np.int64)
    items: dict[int, set[int]] = {}
    for size in tests.sizes:
        starts, hashes = window_hashes(words, size)
        maybe = tests.known[hashes >> np.uint64(64 - FILTER_BITS)]
        starts, hashes = starts[maybe], hashes[maybe]
        low = np.searchsorted(tests.hashes, hashes, side="left")
        high = np.searchsorted(tests.hashes, hashes, side="right")
        for at in np.flatnonzero(high > low).tolist():
            start = int(starts[at])
            own = words.plain[words.offsets[start] : words.offsets[start + size]]
            for entry in range(low[at], high[at]):
                if tests.plain[tests.texts[entry]] == own:
                    steps[start] += 1
                    steps[start + size] -= 1
                    met = tests.of[tests.first[entry] : tests.first[entry + 1]]
                    items.setdefault(int(words.docs[start]), set()).update(met.tolist())
    return np.cumsum(steps[:-1]) > 0, items


def runs_of(flags: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of runs of hit words; a run ends with its text."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (docs[at[1:]] != docs[at[:-1]])
    first = at[new]
    last = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1])
    return first, last


def scanner(tests: Broadcast, hits_only: bool):
    """Texts to word counts, hit words, items and spans, by the slice's windows."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: TestSet = tests.value
        for frame in frames:
            for piece in by_bytes([frame], "text", BATCH_CHARS):
                words = located(piece["text"].tolist())
                flags, met = confirmed(words, table)
                firsts, lasts = runs_of(flags, words.docs)
                # Code points: bytes that do not continue a character
                points = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])
                base = points[words.limits[:-1]]
                before = np.cumsum(words.counts) - words.counts
                owner = words.docs[firsts]
                spans: list[list[dict]] = [[] for _ in range(len(piece))]
                for doc, a, b, f, l in zip(
                    owner.tolist(),
                    (points[words.starts[firsts]] - base[owner]).tolist(),
                    (points[words.ends[lasts]] - base[owner]).tolist(),
                    (firsts - before[owner]).tolist(),
                    (lasts - before[owner] + 1).tolist(),
                ):
                    spans[doc].append({"start": a, "end": b, "first_word": f, "past_word": l})
                hit = np.bincount(words.docs[flags], minlength=len(piece))
                out = piece.drop(columns=["text"]).assign(
                    n_words=words.counts,
                    n_hit=hit,
                    items=[[table.items[i] for i in sorted(met.get(d, ()))] for d in range(len(piece))],
                    spans=spans,
                )
                yield out[out["n_hit"] > 0] if hits_only else out

    return run


SPANS = "array<struct<start:long,end:long,first_word:long,past_word:long>>"
FOUND = f"n_words long, n_hit long, items array<string>, spans {SPANS}"


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"))


def segments(benchmark: DataFrame, window: int, segment: int = SEGMENT) -> DataFrame:
    """``item, text, windows, bytes``: words of items, long ones in overlapping segments."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), plain_words(text_of("text")).alias("words")).filter(
        F.size("words") > 0
    )
    last = F.greatest(F.size("words") - window, F.lit(0))
    parts = words.select("item", "words", F.explode(F.sequence(F.lit(0), last, F.lit(segment))).alias("at"))
    cut = F.slice("words", F.col("at") + 1, segment + window - 1)
    return parts.select(
        "item",
        F.array_join(cut, " ").alias("text"),
        F.greatest(F.size(cut) - window + 1, F.lit(1)).cast("long").alias("windows"),
    ).withColumn("bytes", F.octet_length("text").cast("long"))


def slices(benchmark: DataFrame, window: int, windows: int = SET_WINDOWS, size: int = SET_BYTES) -> Iterator[Broadcast]:
    """The benchmark's windows, in parts small enough for every task."""
    parts = segments(benchmark, window).distinct()
    total = parts.agg(F.sum("windows").alias("windows"), F.sum("bytes").alias("bytes")).first()
    count = max(-(-(total["windows"] or 0) // windows), -(-(total["bytes"] or 0) // size))
    context = benchmark.sparkSession.sparkContext
    for number in range(count):
        own = parts if count == 1 else parts.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == number)
        rows = own.select("item", "text").toPandas()
        ids = [None if pd.isna(i) else i for i in rows["item"]]
        yield context.broadcast(test_set(ids, rows["text"].tolist(), window))


def scanned(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, windows: int = SET_WINDOWS, size: int = SET_BYTES
) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` for every row of ``docs`` (doc_id, text).

    ``items`` are the ids, as text and in its order, of items with a window in the document. ``spans``
    are runs of hit words: first and past the last code point, and word.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    parts = list(slices(benchmark, window, windows, size))
    if len(parts) <= 1:
        tests = parts[0] if parts else docs.sparkSession.sparkContext.broadcast(test_set([], [], window))
        return rows.mapInPandas(scanner(tests, False), f"doc_id long, {FOUND}")
    keyed = with_key(rows)
    counted = keyed.select("doc_id", "key", "id", F.size(plain_words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(hits_by_key(keyed, parts), ["id", "key"], "left")
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past_word"] - s["first_word"])
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(covered, F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
    )


def with_key(rows: DataFrame) -> DataFrame:
    """Rows with ``id, key``: those with the same id and text have the same hits."""
    return rows.withColumn("key", F.sha2(text_of("text"), 256)).withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def hits_by_key(keyed: DataFrame, parts: list[Broadcast]) -> DataFrame:
    """``id, key, items, spans`` of the texts that any slice hits; one scan for each slice."""
    rows = keyed.select("id", "key", text_of("text").alias("text"))
    hits = rows.mapInPandas(scanner(parts[0], True), f"id string, key string, {FOUND}")
    for part in parts[1:]:
        hits = hits.unionByName(rows.mapInPandas(scanner(part, True), f"id string, key string, {FOUND}"))
    # Repeated rows bring the same lists again: sets keep one of each.
    return hits.groupBy("id", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        merged(F.collect_set("spans")).alias("spans"),
    )


def merged(lists: Column) -> Column:
    """One list of runs of words from several, which may overlap or touch."""
    ordered = F.array_sort(F.array_distinct(F.transform(F.flatten(lists), lambda s: F.struct(s.first_word, s.past_word, s.start, s.end))))

    def add(held: Column, run: Column) -> Column:
        last = F.element_at(held, -1)
        longer = run.past_word > last.past_word
        joined = F.struct(
            last.first_word.alias("first_word"),
            F.when(longer, run.past_word).otherwise(last.past_word).alias("past_word"),
            last.start.alias("start"),
            F.when(longer, run.end).otherwise(last.end).alias("end"),
        )
        touching = F.coalesce(run.first_word <= last.past_word, F.lit(False))
        return F.when(
            touching, F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(joined))
        ).otherwise(F.concat(held, F.array(run)))

    empty = F.array().cast("array<struct<first_word:long,past_word:long,start:long,end:long>>")
    # element_at of an empty list is an error; the first run starts the list.
    whole = F.aggregate(
        F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(1))), F.concat(empty, F.slice(ordered, 1, 1)), add
    )
    return F.transform(whole, lambda s: F.struct(s.start, s.end, s.first_word, s.past_word)).cast(SPANS)


def without(text: str | None, spans: Iterable) -> str | None:
    if text is None or not len(spans):
        return text
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : span["start"]])
        at = span["end"]
    return "".join([*kept, text[at:]])


def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([without(t, () if s is None else s) for t, s in zip(texts, spans)], dtype=object)


def cleaned(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW, windows: int = SET_WINDOWS) -> DataFrame:
    """The rows of ``docs``, all columns kept: hit words cut out of ``text``, or rows with hits left out.

    ``remove`` is "spans" (from a run's first word to its last one) or "documents". Only the runs of
    texts with hits are gathered, by id and hash of the text, and joined to the rows.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: {remove}")
    own = docs.columns
    parts = list(slices(benchmark, window, windows))
    if not parts:
        return docs
    # The row travels as one struct, so that columns of any name keep their own.
    rows = with_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), "doc_id", F.col("text").cast("string").alias("text")))
    hits = hits_by_key(rows, parts).select("id", "key", "spans")
    if remove == "documents":
        rest = rows.join(hits, ["id", "key"], "left_anti")
        return rest.select(*[F.col("row").getField(c).alias(c) for c in own])
    text = F.when(F.col("spans").isNotNull(), F.pandas_udf(cut, "string")("text", "spans")).otherwise(F.col("text"))
    joined = rows.join(hits, ["id", "key"], "left").select("row", text.alias("text"))
    return joined.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in own])


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``."""
    return scanned(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

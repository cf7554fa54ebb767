"""Mixing sources to target weights by hash thresholds.

Every document has a fixed 60-bit hash. Words are summed by source and hash bucket; the
bucket in which a source's budget runs out is cut into finer buckets, level by level, until
it holds one hash value. What a document contributes then follows from comparing its hash
with its source's threshold: documents are neither sorted nor shuffled, and sources of any
size cost the same few sums. Thresholds are nested: a larger budget keeps all documents of a
smaller one.

Cases: a null text has size 0; null sources form one source of their own, last in order; a
source without words has target 0. Rows that are alike in id and text have the same hash.
If the budget ends at a single row, that row is taken whole when this comes nearer to the
target; if it ends at several alike rows, they share what is left evenly, in words, to the word:
each takes the words between two steps of the running share. Alike rows are numbered by their place
in written partitions, so that any number of them is dealt with by many tasks. Very long texts are
counted whole; other columns do not matter. No documents give no sources and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendwell.llm.common import small_side, text_of, word_count
from lendwell.operators.ordered import numbered
from lendwell.session import checkpointed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
HASH_BITS = 60
LEVEL_BITS = 12


def source_key(source: str = "source") -> Column:
    """Source names as keys without nulls, in the order of the names, null last."""
    return F.when(F.col(source).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(source).cast("string")))


def document_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The first 60 bits of an MD5 over id and text."""
    whole = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), text_of(text))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Narrow rows ``doc_id, mix_key, mix_hash, size``."""
    return docs.select(
        "doc_id",
        source_key().alias("mix_key"),
        document_hash().alias("mix_hash"),
        word_count(text_of("text")).alias("size"),
    )


def targets(rows: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """``mix_key, source_size, target`` of every source: weighted shares, capped and reshared."""
    sources = rows.groupBy("mix_key").agg(F.sum("size").alias("source_size"))
    listed = F.array(*[F.lit(int(w)) for w in weights])
    ranked = checkpointed(
        numbered(sources, [], ["mix_key"]).select(
            "mix_key",
            "source_size",
            F.get(listed, ((F.col("position") - 1) % len(weights)).cast("int")).alias("weight"),
        )
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap, rate, capped_before = F.col("source_size") * most, 0.0, -1
    while True:
        above = cap < F.lit(rate) * F.col("weight")
        capped, held, free = ranked.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if capped == capped_before or not free:
            break
        capped_before, rate = capped, (share * total - held) / free
    target = F.least(cap.cast("double"), F.lit(float(rate)) * F.col("weight"))
    return ranked.select("mix_key", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add to each source its whole repeats and the hash at which the rest of its budget ends."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = checkpointed(
        wanted.withColumn("repeats", whole.cast("long")).withColumns(
            {
                "budget": F.col("target") - F.col("repeats") * F.col("source_size"),
                "spent": F.lit(0).cast("long"),
                "prefix": F.lit(0).cast("long"),
                "edge": F.lit(None).cast("long"),
                "edge_rows": F.lit(0).cast("long"),
                "edge_words": F.lit(0).cast("long"),
                "open": F.col("source_size") > 0,
            }
        )
    )
    kept = ["mix_key", "source_size", "target", "repeats", "budget"]
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        still = state.filter("open")
        count = still.count()
        if not count:
            break
        shift = HASH_BITS - LEVEL_BITS * level
        bucket = F.shiftright("mix_hash", shift)
        inside = rows.join(small_side(still.select("mix_key", "prefix"), count), "mix_key").filter(
            F.shiftright("mix_hash", shift + LEVEL_BITS) == F.col("prefix")
        )
        sums = inside.groupBy("mix_key", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"),
            F.count(F.lit(1)).alias("bucket_rows"),
            F.min("mix_hash").alias("low"),
            F.max("mix_hash").alias("high"),
        )
        # At most 2 ** LEVEL_BITS buckets of a source meet here.
        up_to = Window.partitionBy("mix_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        reached = (
            sums.withColumn("up_to", F.sum("words").over(up_to))
            .join(small_side(still.select(*kept, "spent"), count), "mix_key")
            .filter(
                (F.col("spent") + F.col("up_to") > F.col("budget"))
                & (F.col("spent") + F.col("up_to") - F.col("words") <= F.col("budget"))
                & (F.col("words") > 0)
            )
            .select(
                *kept,
                (F.col("spent") + F.col("up_to") - F.col("words")).alias("spent"),
                F.col("bucket").alias("prefix"),
                F.col("low").alias("edge"),
                F.col("bucket_rows").alias("edge_rows"),
                F.col("words").alias("edge_words"),
                (F.col("low") != F.col("high")).alias("open"),
            )
        )
        state = checkpointed(state.filter(~F.col("open")).unionByName(reached))
    return state.drop("prefix", "open")


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: size, target, whole repeats and threshold."""
    return thresholds(rows, targets(rows, weights, share, most))


def taken(size: Column) -> Column:
    """Words the mix takes from a document that does not share its hash, from its hash and its source's plan."""
    rest = F.col("budget") - F.col("spent")
    nearer = F.when(2 * rest >= F.col("edge_words"), size).otherwise(0)
    part = F.when(F.col("mix_hash") < F.col("edge"), size).when(F.col("mix_hash") == F.col("edge"), nearer).otherwise(0)
    return (F.col("repeats") * size + F.coalesce(part, F.lit(0))).cast("long")


def sharing() -> Column:
    """Rows at which the budget ends together with rows that are alike."""
    return F.coalesce((F.col("mix_hash") == F.col("edge")) & (F.col("edge_rows") > 1), F.lit(False))


def with_words_before(written: DataFrame) -> DataFrame:
    """Written rows with ``words_before``: those of the rows of the same source before, in order of place."""
    placed = written.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    inside = Window.partitionBy("mix_key", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source and partition that holds such rows
    parts = placed.groupBy("mix_key", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("mix_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(parts.select("mix_key", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")))
    return (
        placed.withColumn("words_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(small_side(offsets, offsets.count()), ["mix_key", "part"])
        .withColumn("words_before", F.col("words_before") + F.col("offset"))
        .drop("part", "place", "offset")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    rows = checkpointed(sized(docs))
    by_source = plan(rows)
    joined = rows.join(small_side(by_source, by_source.count()), "mix_key")
    columns = ["doc_id", "size", "source_size", "target"]
    alone = joined.filter(~sharing()).select(*columns, taken(F.col("size")).alias("taken"))
    if not by_source.filter("edge_rows > 1").head(1):
        return alone
    rest = F.col("budget") - F.col("spent")

    def share(words: Column) -> Column:
        return F.floor(words * rest / F.col("edge_words"))

    own = share(F.col("words_before") + F.col("size")) - share(F.col("words_before"))
    words = (F.col("repeats") * F.col("size") + own).cast("long")
    alike = with_words_before(checkpointed(joined.filter(sharing())))
    return alone.unionByName(alike.select(*columns, words.alias("taken")))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with its own columns.

    Of alike rows at which a budget ends, as many are taken whole as come nearest to it.
    """
    by_source = plan(checkpointed(sized(docs)))
    own = docs.columns
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("mix_row"),
        source_key().alias("mix_key"),
        document_hash().alias("mix_hash"),
        word_count(text_of("text")).alias("size"),
    ).join(small_side(by_source, by_source.count()), "mix_key")
    size = F.col("size")
    whole = F.when(size > 0, F.round(taken(size) / size)).otherwise(F.col("repeats")).cast("int")
    times = marked.filter(~sharing()).select("mix_row", whole.alias("times"))
    if by_source.filter("edge_rows > 1").head(1):
        alike = with_words_before(checkpointed(marked.filter(sharing())))
        again = (F.col("words_before") + size / 2 <= F.col("budget") - F.col("spent")).cast("long")
        times = times.unionByName(alike.select("mix_row", (F.col("repeats") + again).cast("int").alias("times")))
    return (
        times.filter(F.col("times") > 0)
        .withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(*[F.col("mix_row").getField(c).alias(c) for c in own])
    )

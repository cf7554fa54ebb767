"""Document fingerprints from closed syncmers, with built-in functions only.

A k-mer (12 code points) is an anchor when the lowest hash among its inner substrings
(5 code points) belongs to its first or last one. Whether it is an anchor depends on the k-mer
alone, so a passage has the same anchors in every text, and those of an edited text can be put
together from its parts: the anchors of what was kept, taken by position, and those of what was
inserted with the k - 1 code points before it. A fingerprint is the list of the 64 lowest
distinct anchor hashes, as hex digits; the likeness of two fingerprints estimates the Jaccard
similarity of the two texts' anchors (exact for up to 64 anchors together), with a standard
error of at most 0.0625.

The edited text of a document is its text with the last half replaced by the start of the next
document's. Ids are cut into runs, ranges of about 2,000 documents; each run gets a copy of the
first document of the run after it, so that texts are shuffled once, by run. Rows that share an
id would make a run as large as they are many: one of them stands for the id in its run, and
all of them meet their next document in a join.

Cases: a null text is empty; a text below k code points has one anchor, the whole of it, and
an empty text has none; two texts without anchors are alike (1), one without and one with are
not (0). Rows that share an id have one next document, and as a next document that id is the
row whose text has the lowest hash. A null id comes after all others. A single id is its own
next document. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendwell.llm.common import small_side, text_of
from lendwell.operators.ordered import in_runs, neighbour
from lendwell.session import checkpointed

INNER = 5
INNER_COUNT = 8  # inner substrings of a k-mer
KMER = INNER + INNER_COUNT - 1
SKETCH = 64
RUN_ROWS = 2000
COARSE_RUNS = 64


def anchor_expression(text: str) -> str:
    """SQL for the anchors of a text by position: a 31-bit hash, or null where none starts."""
    last = INNER_COUNT - 1
    # Comparisons in order of distance: most positions fail at the first or second one.
    low_first = " AND ".join(f"x <= get(h, i + {j})" for j in range(1, INNER_COUNT))
    low_last = " AND ".join(f"get(h, i + {last}) <= get(h, i + {j})" for j in range(last - 1, 0, -1))
    kmer = ", ".join(["x", *(f"get(h, i + {j})" for j in range(3, last, 4)), f"get(h, i + {last})"])
    hashes = f"transform(regexp_extract_all({text}, '(?s)(?=(.{{{INNER}}}))', 1), g -> hash(g))"
    anchors = f"""transform(h, (x, i) ->
        if(({low_first}) OR ({low_last} AND get(h, i + {last}) <= x),
           cast(shiftrightunsigned(xxhash64({kmer}), 33) AS int), NULL))"""
    return f"transform(array({hashes}), h -> {anchors})[0]"


def whole_anchor(text: str) -> str:
    """SQL for the anchors of a text too short for a k-mer."""
    one = f"array(cast(shiftrightunsigned(xxhash64({text}), 33) AS int))"
    return f"if({text} = '', cast(array() AS array<int>), {one})"


def lowest(anchors: str | Column) -> Column:
    column = F.expr(anchors) if isinstance(anchors, str) else anchors
    return F.slice(F.sort_array(F.array_distinct(column)), 1, SKETCH)


def as_hex(sketch: str) -> Column:
    return F.concat_ws("", F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def likeness(left: str, right: str) -> Column:
    """Share of the lowest hashes of both sketches together that are in each of them."""
    both = F.slice(F.sort_array(F.array_union(left, right)), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect(left, right), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, body, n_chars, sketch``: the lowest anchors of each text.

    ``kept_sketch`` holds those of the part that editing keeps.
    """
    rows = docs.select("doc_id", text_of("text").alias("body"))
    rows = rows.withColumn("n_chars", F.length("body").cast("long"))
    rows = rows.withColumn("kept_chars", (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    at = rows.withColumn("anchors", F.expr(anchor_expression("body")))
    within = f"slice(anchors, 1, greatest(kept_chars - {KMER - 1}, 0))"
    return at.select(
        "doc_id",
        "body",
        "n_chars",
        "kept_chars",
        lowest(f"if(n_chars < {KMER}, {whole_anchor('body')}, array_compact(anchors))").alias("sketch"),
        lowest(f"array_compact({within})").alias("kept_sketch"),
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` for every row of ``docs`` (doc_id, text)."""
    return sketched(docs).select("doc_id", "n_chars", as_hex("sketch").alias("fingerprint"))


def id_key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("none"))


def run_of(ids: DataFrame, count: int) -> Column:
    """Number of the run that an id falls into: ascending with the ids, -1 for null."""
    parts = min(COARSE_RUNS, -(-count // RUN_ROWS))
    shares = [i / parts for i in range(1, parts)]
    low, high, *inner = ids.agg(
        F.min("doc_id"), F.max("doc_id"), *[F.percentile_approx("doc_id", share, 1000) for share in shares]
    ).first()
    doc_id = F.col("doc_id")
    if low is None:
        return F.lit(-1).cast("long")
    borders = sorted({low, *inner, high + 1})
    fine = -(-count // (parts * RUN_ROWS))
    run = F.lit(-1)
    for i, (start, end) in enumerate(zip(borders, borders[1:])):
        within = F.floor((doc_id - start).cast("double") / F.lit(float(end - start)) * fine)
        run = F.when(doc_id >= start, i * fine + F.least(within, F.lit(fine - 1))).otherwise(run)
    return F.when(doc_id.isNull(), -1).otherwise(run).cast("long")


def neighbours(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Add ``next_body, next_sketch`` to rows (sketched) that have an id each to themselves."""
    run = run_of(ids, ids.count())
    firsts = ids.groupBy(run.alias("run")).agg(F.max("doc_id").alias("first_id"))
    # One row per run; the first document of a run is copied to the run before it, in descending order.
    around = Window.orderBy(F.col("run").desc())
    borders = checkpointed(
        firsts.withColumn("to_run", F.lag("run").over(around)).withColumn("lowest", F.min("run").over(Window.partitionBy()))
    ).select("run", "first_id", F.coalesce("to_run", "lowest").alias("to_run"))
    copies = F.when(
        F.col("doc_id").eqNullSafe(F.col("first_id")),
        F.array(F.struct(F.col("run"), F.lit(False).alias("copy")), F.struct(F.col("to_run").alias("run"), F.lit(True).alias("copy"))),
    ).otherwise(F.array(F.struct(F.col("run"), F.lit(False).alias("copy"))))
    dealt = (
        rows.withColumn("run", run)
        .join(small_side(borders, borders.count()), "run")
        .withColumn("place", F.explode(copies))
        .select(*rows.columns, "place.run", "place.copy")
    )
    inside = Window.partitionBy("run").orderBy("copy", F.col("doc_id").desc_nulls_last())
    return dealt.withColumns(
        {"next_body": F.lead("body").over(inside), "next_sketch": F.lead("sketch").over(inside)}
    ).filter(~F.col("copy")).select(*rows.columns, "next_body", "next_sketch")


def by_join(rows: DataFrame, ids: DataFrame, shared: DataFrame) -> DataFrame:
    """Add ``next_body, next_sketch`` to the rows whose id is shared; rows of one id are a skewed join's."""
    last = ids.agg(F.max("doc_id")).first()[0]
    runs = in_runs(ids.select("doc_id", F.lit(1).alias("here")), [], ["doc_id"])
    before = neighbour(runs, [], ["doc_id"], ["doc_id", "here"])
    wrapped = F.lit("none" if last is None else str(last))
    following = F.when(F.col("near_here").isNull(), wrapped).otherwise(id_key("near_doc_id"))
    mapping = before.select(id_key("doc_id").alias("doc_key"), following.alias("next_key")).join(
        shared.select("doc_key"), "doc_key", "left_semi"
    )
    after = standing(rows, shared).select(
        id_key("doc_id").alias("next_key"), F.col("body").alias("next_body"), F.col("sketch").alias("next_sketch")
    )
    found = mapping.join(after, "next_key").drop("next_key")
    return rows.withColumn("doc_key", id_key("doc_id")).join(found, "doc_key").drop("doc_key")


def standing(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """One row per id: of a shared id the one whose text has the lowest hash."""
    if shared is None:
        return rows
    marked = rows.withColumn("doc_key", id_key("doc_id")).join(shared, "doc_key", "left")
    single = marked.filter("id_text IS NULL")
    chosen = marked.filter(F.xxhash64("body") == F.col("id_text")).dropDuplicates(["doc_key"])
    return single.unionByName(chosen).select(*rows.columns)


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are."""
    ids = checkpointed(
        docs.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("id_rows"), F.min(F.xxhash64(text_of("text"))).alias("id_text")
        )
    )
    shared = ids.filter("id_rows > 1").select(id_key("doc_id").alias("doc_key"), "id_text")
    shared = shared if shared.head(1) else None
    rows = sketched(docs)
    joined = neighbours(standing(rows, shared), ids)
    if shared is not None:
        alone = joined.withColumn("doc_key", id_key("doc_id")).join(shared, "doc_key", "left_anti")
        joined = alone.drop("doc_key").unionByName(by_join(rows, ids, shared))
    kept = F.substring("body", F.lit(1), F.col("kept_chars"))
    inserted = F.substring("next_body", F.lit(1), (F.col("n_chars") - F.col("kept_chars")).cast("int"))
    parts = joined.withColumns({"kept": kept, "inserted": inserted}).drop("body", "next_body")
    edited = parts.select(
        "doc_id",
        "n_chars",
        "sketch",
        "next_sketch",
        "kept_sketch",
        F.concat("kept", "inserted").alias("edited"),
        F.expr(anchor_expression(f"concat(right(kept, {KMER - 1}), inserted)")).alias("anchors"),
    )
    merged = edited.select(
        "doc_id",
        "n_chars",
        "sketch",
        "next_sketch",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        lowest(
            f"if(length(edited) < {KMER}, {whole_anchor('edited')}, concat(kept_sketch, array_compact(anchors)))"
        ).alias("edited_sketch"),
    )
    return merged.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex("sketch").alias("fingerprint"),
        as_hex("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )

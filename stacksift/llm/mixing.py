"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. The rows of a source are range-partitioned by that
key, so many ranges that each holds about ``RANGE_ROWS`` rows; distributed prefix sums of
word counts run inside the ranges and over the range totals. Each source is cut at its
exact budget: whole epochs for all its documents, then the documents before the cut once
more, and the first words of the document at the cut.

Only ids, keys and counts are shuffled. The texts are read a second time and compared with
the cut of their source, one row per source.

Defined cases: a null text has no words; a null source is a source, the last; a null id is
the key of an empty id; documents with one key (repeated rows) share what is left at the
cut in proportion to their words, rounded down; a document without words is never taken;
an empty table mixes to an empty table. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinals import with_ordinals
from ..session import cut_lineage
from .common import sent_if_small, word_count

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
RANGE_ROWS = 1000
#: Sources that may be sent to all executors, 50 bytes each; beyond it, rows are joined by shuffles.
MOST_SENT = 200_000
#: Keys are numbers below 2 ** KEY_BITS, from the first hexadecimal digits of a hash.
KEY_BITS = 60


def mix_key(doc_id: Column, seed: str = "mix") -> Column:
    """A hash-random number for an id; the same in every run."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row`` with all columns, and ``mix_source``, ``mix_key`` and ``mix_size``."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("mix_source"),
        mix_key(F.col(doc_id)).alias("mix_key"),
        word_count(F.col(text)).alias("mix_size"),
    )


def source_targets(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source its rows, size, target and budget in words.

    Targets share the whole size by weight; none is above ``most`` times its source, and
    what is over goes to the others. The level that a unit of weight gets rises until the
    set of full sources stands still; each round reads one row of sums.
    """
    totals = slim.groupBy("mix_source").agg(
        F.count(F.lit(1)).alias("mix_rows"), F.sum("mix_size").alias("source_size")
    )
    ranked = with_ordinals(totals, [F.col("mix_source").asc_nulls_last()], "place")
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = cut_lineage(
        ranked.select("mix_source", "mix_rows", "source_size",
                      F.get(cycle, F.pmod(F.col("place"), F.lit(len(weights))).cast("int")).alias("weight"))
    )
    most_words = F.col("source_size") * most
    whole = sources.agg(F.sum("source_size").alias("size")).first()["size"] or 0
    level, full = 0.0, -1
    while whole:
        over = (F.col("weight") * level >= most_words) if full >= 0 else F.lit(False)
        now = sources.agg(
            F.count_if(over).alias("full"),
            F.sum(F.when(over, most_words).otherwise(0)).alias("held"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if now["full"] == full or not now["weight"]:
            break
        full, level = now["full"], (whole - now["held"]) / now["weight"]
    target = F.least(most_words.cast("double"), F.col("weight") * F.lit(float(level)))
    return sources.select(
        "mix_source", "mix_rows", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("budget")
    )


def cuts(slim: DataFrame, targets: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per source with words: whole epochs, and the key, size and words left at its cut."""
    ranges = F.ceil(F.col("mix_rows") / range_rows)
    ranged = slim.join(targets, slim.mix_source.eqNullSafe(targets.mix_source)).select(
        slim.mix_source,
        F.floor(F.col("mix_key") / F.lit(float(2**KEY_BITS)) * ranges).alias("part"),
        "mix_key",
        "mix_size",
    )
    units = ranged.groupBy("mix_source", "part", "mix_key").agg(F.sum("mix_size").alias("size"))
    inside = Window.partitionBy("mix_source", "part").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = ranged.groupBy("mix_source", "part").agg(F.sum("mix_size").alias("range_size"))
    below = Window.partitionBy("mix_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("mix_source").alias("s"), F.col("part").alias("p"),
        F.coalesce(F.sum("range_size").over(below), F.lit(0)).alias("offset"),
    )
    placed = units.join(offsets, F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select(
        F.col("mix_source").alias("cut_source"), F.col("mix_key").alias("cut_key"), F.col("size").alias("cut_size"),
        (F.col("offset") + F.col("inside")).alias("before"),
    )
    budget = targets.filter(F.col("source_size") > 0).select(
        "mix_source",
        F.expr("budget div source_size").alias("epochs"),
        (F.col("budget") % F.col("source_size")).alias("rest"),
    )
    at_cut = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("cut_size"))
    return budget.join(placed, F.col("mix_source").eqNullSafe(F.col("cut_source")) & at_cut).select(
        "cut_source", "epochs", "cut_key", "cut_size", (F.col("rest") - F.col("before")).alias("cut_rest")
    )


def taken_words(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` with ``taken``: the words the mix takes of a document, repeats counted."""
    size = F.col("mix_size")
    last = F.when(F.col("mix_key") < F.col("cut_key"), size)
    last = last.when(F.col("mix_key") == F.col("cut_key"), F.expr("cut_rest * mix_size div cut_size")).otherwise(F.lit(0))
    return rows.join(cut, F.col("mix_source").eqNullSafe(F.col("cut_source")), "left").withColumn(
        "taken", F.coalesce(F.col("epochs") * size + last, F.lit(0)).cast("long")
    ).drop(*cut.columns)


def _kept(per_source: DataFrame) -> DataFrame:
    """A table of one row per source, computed once; sent to all executors if it is small."""
    kept = cut_lineage(per_source)
    return sent_if_small(kept, kept.count(), MOST_SENT)


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """Targets and cuts per source of ``documents``."""
    slim = cut_lineage(sized(docs.select("doc_id", "text", "source")).drop("row"))
    targets = _kept(source_targets(slim, weights, most))
    return targets, _kept(cuts(slim, targets))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``taken``."""
    slim = cut_lineage(sized(docs.select("doc_id", "text", "source")).select(
        F.col("row.doc_id").alias("doc_id"), "mix_source", "mix_key", "mix_size"))
    targets = _kept(source_targets(slim.drop("doc_id"), weights, most))
    marked = taken_words(slim, _kept(cuts(slim.drop("doc_id"), targets)))
    of = targets.select(F.col("mix_source").alias("s"), "source_size", "target")
    return marked.join(of, F.col("mix_source").eqNullSafe(F.col("s"))).select(
        "doc_id", F.col("mix_size").alias("size"), "source_size", "target", "taken"
    )


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word, white space kept."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: each document as often as its words are taken, the last one cut.

    Columns and their order stay. ``n_chars`` of a cut text, where there is one, is counted anew.
    """
    _, cut = mix_plan(docs, weights, most)
    marked = taken_words(sized(docs), cut).filter(F.col("taken") > 0)
    full, part = F.expr("taken div mix_size"), F.col("taken") % F.col("mix_size")
    whole = F.array_repeat(F.lit(0).cast("long"), full.cast("int"))
    copies = F.when(part > 0, F.concat(whole, F.array(part))).otherwise(whole)
    rows = marked.select("row", F.explode(copies).alias("first"))
    names = {c: F.col(f"row.`{c}`") for c in docs.columns}
    text = F.when(F.col("first") > 0, first_words(names["text"], F.col("first"))).otherwise(names["text"])
    out = []
    for name, column in names.items():
        if name == "text":
            column = text
        elif name == "n_chars":
            column = F.when(F.col("first") > 0, F.char_length(text).cast(docs.schema[name].dataType)).otherwise(column)
        out.append(column.alias(name))
    return rows.select(*out)

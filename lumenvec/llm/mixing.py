"""Mixing sources to target weights by a low-discrepancy schedule.

A schedule of S slots of equal tokens is laid out: slot k takes the golden-ratio point
frac(k / phi), maps it through the cumulative targets to a source, and gets its rank among the
slots of that source. Each source's documents, shuffled by a hash of their id, form a stream that is
read over and over in blocks of a slot's tokens; slot and block are joined on source and rank. A
document's share is what the slots took of it, at most twice its size.

The documents of the mix are returned in the schedule's order: each stands where the first slot that
takes of it does. So every stretch of the output holds the sources near their weights.

Ranks and places in the stream are prefix sums over bounded parts, so a source with a third of all
rows is spread over many tasks; sums over the sources themselves run over ranges of them; the join of
slots and blocks is on the block's number. Slots grow with the total, so that their number is bounded.

Null text has no words and takes part with size 0; a null source is a source of its own, ordered
last. Repeated rows and ids are told apart by their place in the stream; of rows alike in all columns
as many appear in the mix as their places are taken; maps with their entries in another order are
not alike. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenvec.llm.common import checkpointed, ordered_sums, prefix_sums, words_of

#: Golden-ratio stepping modulo 2**30: the odd number nearest to 2**30 / phi.
STEP, CYCLE = 663608943, 1 << 30
#: Words of a slot, and the number of slots from which on it grows instead.
SLOT_WORDS, MOST_SLOTS = 128, 1 << 27
#: A table of at most so many sources is broadcast.
FEW_SOURCES = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """``source, source_size, weight, target`` for ``sizes (source, source_size)``, one row a source.

    ``percent`` of all words are shared by weight; a target stops at ``most`` times its source's
    size, and what it leaves is shared among the others by weight until none is above. With the
    sources in order of cap to weight, those before the first one that stays below its cap are the
    ones that stop; so one cumulative sum over the table of sources finds the shares.
    """
    by_name = ordered_sums(sizes, [F.col("source").asc_nulls_last()], {"_k": F.lit(1).cast("long")})
    named = by_name.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int")).cast("long"))
    cap = most * F.col("source_size")
    rising = checkpointed(ordered_sums(named, [(cap / F.col("weight")).asc(), F.col("_k").asc()], {"_before": cap, "_lighter": F.col("weight")}))
    whole = rising.agg(F.sum("source_size"), F.sum("weight")).first()
    total = F.lit((whole[0] or 0) * percent / 100)
    left = (total - F.col("_before")) / (F.lit(whole[1] or 0) - F.col("_lighter"))
    free = rising.filter(left * F.col("weight") <= cap)
    level = free.agg(F.min(F.struct("_before", "_lighter"))).first()[0]
    share = F.lit(None).cast("double") if level is None else F.col("weight") * F.lit((whole[0] or 0) * percent / 100 - level["_before"]) / F.lit(whole[1] - level["_lighter"])
    return rising.select("source", "_k", "source_size", "weight", F.least(cap.cast("double"), F.coalesce(share, cap.cast("double"))).alias("target"))


def _ranged(column: str, parts: int):
    """Part of a 32-digit hexadecimal hash, in the hash's order."""
    return (F.conv(F.substring(column, 1, 7), 16, 10).cast("long") * parts / F.lit(1 << 28)).cast("int")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
    slot_words: int | None = None,
    parts: int = 512,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' places, the schedule, and the pieces that it takes.

    Places are ``_id, _row1, _row2, source_id, size, source_size, target, at``, a row for each of
    ``docs``; ``at`` is the place in the source's stream, the first two numbers are hashes of the row. The schedule is ``slot, source_id, rank``.
    Pieces are ``slot, source_id, at, turn, start, length``: in the stream's ``turn``-th reading,
    ``length`` words of the document from word ``start``.
    """
    slim = checkpointed(docs.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), *_row_hashes(docs),
        F.size(words_of(F.col("text").cast("string"))).cast("long").alias("size"),
    ))
    sizes = checkpointed(slim.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")))
    wanted = checkpointed(targets(sizes, weights, percent, most))
    total, n_sources = wanted.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    slot_words = slot_words or max(SLOT_WORDS, int(total / MOST_SLOTS))
    n_slots, scale = int(total / slot_words), F.lit(total or 1.0)
    few = F.broadcast if n_sources <= FEW_SOURCES else lambda frame: frame  # else joined by shuffles

    # Each source owns the points below its bound and not below that of the source before it.
    width = CYCLE // 1024  # sources and slots meet in 1,024 cells of points
    ranges = (
        ordered_sums(wanted, [F.col("_k").asc()], {"_before": F.col("target")})
        .withColumn("_low", F.round(F.col("_before") / scale * CYCLE).cast("long"))
        .withColumn("_high", F.round((F.col("_before") + F.col("target")) / scale * CYCLE).cast("long"))
        .filter("_high > _low")
        .select(
            F.col("_k").alias("source_id"), "_low", "_high",
            F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor((F.col("_high") - 1) / width))).alias("cell"),
        )
    )
    slots = (
        docs.sparkSession.range(n_slots).withColumnRenamed("id", "slot")
        .withColumn("point", (F.col("slot") % CYCLE) * STEP % CYCLE)
        .withColumn("cell", F.floor(F.col("point") / width))
        .join(few(ranges), "cell")
        .filter("point >= _low AND point < _high")
        .withColumn("_part", F.floor(F.col("slot") / max(1024, int(n_slots**0.5))))
        .select("slot", "source_id", "_part", F.lit(1).cast("long").alias("_one"))
    )
    schedule = prefix_sums(slots, "source_id", "_part", ["slot"], "_one", "rank").select("slot", "source_id", "rank")

    key = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))
    placed = (
        slim.join(few(wanted.select(F.col("source").alias("_name"), F.col("_k").alias("source_id"), "source_size", "target")), F.col("_source").eqNullSafe(F.col("_name")))
        .withColumn("_hash", key)
        .withColumn("_part", _ranged("_hash", parts))
        .select("_id", "_row1", "_row2", "source_id", "size", "source_size", "target", "_hash", "_part")
    )
    placed = checkpointed(prefix_sums(placed, "source_id", "_part", ["_hash", "_id", "size", "_row1"], "size", "at").drop("_part", "_hash"))
    starts = F.col("at") + F.col("turn") * F.col("source_size")
    spread = (
        placed.filter("size > 0")
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("_start", starts)
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("_start") / slot_words), F.floor((F.col("_start") + F.col("size") - 1) / slot_words))))
    )
    low = F.greatest(F.col("_start"), F.col("rank") * slot_words)
    end = F.least(F.col("_start") + F.col("size"), (F.col("rank") + 1) * slot_words)
    pieces = spread.join(schedule, ["source_id", "rank"]).select(
        "slot", "source_id", "at", (low - F.col("_start")).alias("start"), (end - low).alias("length"), "turn"
    )
    return placed, schedule, pieces


def _row_hashes(docs: DataFrame) -> list:
    """Two hashes of 64 bits of a whole row; columns with maps, which have no hash, go as JSON."""
    maps = {f.name for f in docs.schema if re.search("map<|variant", f.dataType.simpleString())}
    columns = [F.to_json(F.struct(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*columns).alias("_row1"), F.xxhash64(F.lit(1), *columns).alias("_row2")]


def shares(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row of ``docs``."""
    placed, _, pieces = mix(docs, **options)
    taken = pieces.groupBy("source_id", "at").agg(F.sum("length").alias("_taken"))
    return placed.join(taken, ["source_id", "at"], "left").select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target",
        F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in the schedule's order, with the columns of ``docs``.

    A document appears once for each reading of its source in which the slots take at least half
    of its words: not at all, once or twice. It stands where the first of these slots does. Slots
    run over the whole output: its partitions are ranges of them, sorted.
    """
    placed, _, pieces = mix(docs, **options)
    copies = (
        pieces.groupBy("source_id", "at", "turn").agg(F.sum("length").alias("_taken"), F.min("slot").alias("_slot"))
        .join(placed.filter("size > 0"), ["source_id", "at"])
        .filter(2 * F.col("_taken") >= F.col("size"))
        .select(F.col("_row1").alias("_c1"), F.col("_row2").alias("_c2"), "_slot")
    )
    # Rows alike in all columns stand for each other: one is taken as often as all of them are.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_row_hashes(docs)).dropDuplicates(["_row1", "_row2"])
    return (
        rows.join(copies, (F.col("_row1") == F.col("_c1")) & (F.col("_row2") == F.col("_c2")))
        .repartitionByRange(F.col("_slot").asc(), F.col("_row1").asc()).sortWithinPartitions("_slot", "_row1", "_row2")
        .select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    )

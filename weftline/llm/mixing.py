"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame operations only).

All words of a source, its documents in hashed order, form a tape that is cut into blocks of equal length. The points
of a golden-ratio sequence are mapped through the sources' cumulative targets; the k-th point that falls to a source
takes the k-th block of its tape, round and round for at most `max_repeats` epochs. Each source gives its target to the
word at any length of blocks: what its slots hold beyond the target is not taken, and what they lack comes after them.

No source is ever gathered in one task: prefix sums over documents and ranks over slots are taken in two levels,
first inside chunks of bounded size, then over the chunks' totals.

Defined cases: a null text has size 0; a null source is a source of its own, placed last; null or repeated doc_ids are
ordinary rows, each with its own place on the tape (the order is a hash of doc_id and text; rows equal in both stand next
to each other, in any order); texts of any length are counted whole, and one of them
may hold many blocks; an empty table gives an empty result; documents without words take 0; further columns of docs may
have any names, as only doc_id, source, the text and those named in carry are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, WORD, Scratch, fresh, small, text_of

#: Step of the golden-ratio sequence in 32-bit integers, odd and nearest to 2^32 / 1.618...
GOLDEN = 2654435769
SPAN = 1 << 32
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Blocks are as short as least_block words, or longer so that no more than most_slots are scheduled at any corpus size.
LEAST_BLOCK = 8
MOST_SLOTS = 1 << 22
CHUNK = 1 << 13
CELLS = 1 << 10


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row for each source: source, source_size, target, low, high (its part of [0, 2^32)).

    The targets are the water level at which sources either get their weight's share or stop at max_repeats times
    their size. Sources fill up in the order of size / weight, so the level follows from running sums over the table
    of sources, which has one row for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    picks = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("rank", F.row_number().over(by_name))
    per = per.withColumn("weight", F.element_at(picks, (F.col("rank") - 1) % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * max_repeats).withColumn("fills_at", F.col("cap") / F.col("weight"))
    fill = W.orderBy("fills_at", "rank")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("total", F.sum("source_size").over(everything))
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    # The first source, in order of filling, that the level leaves below its cap sets the level for it and all after it.
    per = per.withColumn("water", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "rank", "level"))).over(everything)["level"])
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")))
    upto = by_name.rowsBetween(W.unboundedPreceding, 0)
    high = F.floor(F.try_divide(F.sum("target").over(upto), F.sum("target").over(everything)) * SPAN)
    per = per.withColumn("high", F.coalesce(high, F.lit(0)))
    per = per.withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0)))
    return per.select("source", "source_size", "source_rows", "target", "low", "high", "total", (F.col("rank") - 1).alias("source_no"))


def mix(
    docs: DataFrame,
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    least_block: int = LEAST_BLOCK,
    most_slots: int = MOST_SLOTS,
    seed: str = "mix-1",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, first_slot (when the mix first reads it;
    null: never), epoch_slots (the same for each time that it is read).

    carry: further columns of docs to hand through.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = scratch.table(
        docs.select(
            "doc_id",
            "source",
            *carry,
            F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
            # With the text's digest, so that rows without or with one doc_id spread like others.
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text).cast("binary")))).alias("order"),
        )
    )
    per, of = scratch.counted(targets(sized, weights, max_repeats))
    plan = per.agg(F.max("total").alias("total"), F.max("source_rows").alias("rows")).first()
    total, most_rows = plan["total"] or 0, plan["rows"] or 0
    block = max(least_block, math.ceil(total / most_slots))
    slots_n = math.ceil(total / block)
    # Buckets by the leading hexadecimal digits of the hashed order, so many that each holds about CHUNK documents of a source.
    digits = max(0, math.ceil(math.log(max(1, most_rows / CHUNK), 16)))

    named = sized.join(small(per.select("source", "source_no", "source_size", "target"), of["rows"]), sized["source"].eqNullSafe(per["source"]), "left").select(
        sized["doc_id"], sized["source"], *carry, "size", "order", "source_no", "source_size", "target", F.substring("order", 1, digits).alias("bucket")
    )
    local = W.partitionBy("source_no", "bucket").orderBy("order", "size", "doc_id")
    placed = named.withColumn("place", F.row_number().over(local)).withColumn("inside", F.sum("size").over(local.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    sums = named.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    over = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(over), F.lit(0))).drop("bucket_size")
    tape = placed.join(sums, ["source_no", "bucket"]).withColumn("begin", F.col("offset") + F.col("inside"))

    slots = schedule(spark, per, slots_n, scratch)
    # Targets rounded by their running sums, so that the words taken add up to the total.
    upto = F.round(F.sum(F.coalesce("target", F.lit(0.0))).over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0))).cast("long")
    ends = per.withColumn("upto", upto).withColumn("share", F.col("upto") - F.coalesce(F.lag("upto").over(W.orderBy("source_no")), F.lit(0)))
    ends = ends.select("source_no", F.least("share", F.col("source_size") * max_repeats).alias("tape_end"))
    pieces = tape.join(small(ends, of["rows"]), "source_no", "left")
    epochs = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    pieces = pieces.withColumn("epoch", F.explode(epochs))
    start = F.col("begin") + F.col("epoch") * F.col("source_size")
    pieces = pieces.withColumn("from", start).withColumn("to", F.least(start + F.col("size"), F.col("tape_end")))
    pieces = pieces.withColumn(
        "block",
        F.explode_outer(F.when(F.col("to") > F.col("from"), F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(`to` - 1) div {block}")))),
    )
    words = F.least(F.col("to"), (F.col("block") + 1) * block) - F.greatest(F.col("from"), F.col("block") * block)
    key = ["source_no", "bucket", "place", "doc_id", *carry, "source", "size", "source_size", "target"]
    joined = pieces.join(slots, ["source_no", "block"], "left")
    # Blocks that the slots lack are read after the last slot.
    at = F.when(F.col("block").isNotNull(), F.coalesce("slot", F.col("block") + slots_n))
    return (
        joined.groupBy(*key)
        .agg(
            F.sum(F.when(F.col("block").isNotNull(), words).otherwise(0)).alias("taken"),
            F.min(at).alias("first_slot"),
            F.array(*[F.min(F.when(F.col("epoch") == k, at)) for k in range(max_repeats)]).alias("epoch_slots"),
        )
        .select("doc_id", "source", *carry, "size", "source_size", "target", "taken", "first_slot", "epoch_slots")
    )


def apply(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed rows with docs' columns: a document once for each epoch in which the mix takes all its words; where it
    takes only the first of them, a row with these words (and their length in n_chars, if docs has it). Rows come in the
    order of the schedule: partitions are consecutive ranges of slots, sorted.

    Each row of docs is taken on its own, also where rows repeat or have no doc_id; rows without words are not taken; texts
    of any length are cut between words; columns of any other name are handed through; an empty table stays empty."""
    spark = docs.sparkSession
    key, size_, taken_, epoch, cut, slots, slot, part = fresh(docs, "__row", "__size", "__taken", "__epoch", "__cut", "__slots", "__slot", "__part")
    scratch = Scratch(spark)
    # Written once, so that a row's number is the same wherever it is read.
    rows = scratch.table(docs.withColumn(key, F.monotonically_increasing_id()))
    plan = mix(rows, text, carry=(key,), **options).filter("taken > 0")
    plan = scratch.table(plan.select(key, F.col("size").alias(size_), F.col("taken").alias(taken_), F.col("epoch_slots").alias(slots)))
    last = plan.agg(F.max(F.array_max(slots))).first()[0] or 0
    found = rows.join(plan, key).select("*", F.posexplode(F.filter(slots, lambda x: x.isNotNull())).alias(epoch, slot))
    found = found.withColumn(epoch, F.col(epoch) + 1)
    left = F.col(taken_) - (F.col(epoch) - 1) * F.col(size_)
    # Words with the blanks before them: the first ones, joined, are the text's beginning. No expression counts them.
    words = F.regexp_extract_all(F.col(text), F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    first = F.array_join(F.slice(words, F.lit(1), left.cast("int")), "")
    found = found.withColumn(cut, F.when(left < F.col(size_), first).otherwise(F.col(text)))
    out = [F.col(cut).alias(text) if c == text else F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        length = F.when(left < F.col(size_), F.length(cut).cast("long")).otherwise(F.col("n_chars"))
        out = [length.alias("n_chars") if c == "n_chars" else o for c, o in zip(docs.columns, out, strict=True)]
    # Slots hold equally many words, so equal ranges of slots are even parts; a part's number is known without sampling.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = found.withColumn(part, (F.col(slot) * parts / (last + 1)).cast("int"))
    return found.repartitionById(parts, F.col(part)).sortWithinPartitions(slot, key, epoch).select(*out)


def schedule(spark, per: DataFrame, slots_n: int, scratch: Scratch) -> DataFrame:
    """The slots: slot, source_no, block (the slot's rank among those of its source, from 0).

    Points find their source by an equality join on cells of the unit interval and a range filter inside the cell;
    ranks are counted in chunks of consecutive slots.
    """
    width = SPAN // CELLS
    cells = per.filter("high > low").select("source_no", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))
    points = spark.range(0, slots_n).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % F.lit(SPAN)).alias("u"))
    points = points.withColumn("cell", F.expr(f"u div {width}"))
    dealt = points.join(cells, "cell").filter("u >= low and u < high").select("slot", "source_no", F.expr(f"slot div {CHUNK * 4}").alias("chunk"))
    dealt = scratch.table(dealt)
    inner = W.partitionBy("source_no", "chunk").orderBy("slot")
    before = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = dealt.withColumn("rank", F.row_number().over(inner) - 1).join(counts, ["source_no", "chunk"])
    return ranked.select("slot", "source_no", (F.col("offset") + F.col("rank")).alias("block"))

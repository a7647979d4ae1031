"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A mix has as many slots as its size holds blocks; a block is BLOCK tokens, fewer in a small mix, which has LEAST_SLOTS slots
at least. Slot s takes the point frac((s + 1/2) * golden ratio) through the cumulative weights of the mix, so every stretch
of the schedule holds the sources in their shares. The documents of a source, shuffled by hash and strung together as often
as `max_repeats` says, are its stream; its k-th slot draws the stream's k-th block. Blocks are equal to the token: a long
document fills several, and one block may end in a document that the next one goes on with.

Slots beyond the end of a source's stream stay empty: the source falls short. They are then numbered anew and take points
through the weights of the sources that have blocks left, until all are filled or no source has any.

The number of slots follows from the tokens, ranks and running totals are two-level sums over chunks, so a source with a
third of all documents is spread over many tasks. Documents go through the tokenizer once, in a narrow map.

Defined results: null and empty texts have 0 tokens and are never drawn; documents with null source belong to no mix;
target rows with a null mix, source or weight, or a weight of 0 or less, are left out; a source without documents has 0
tokens; equal target rows of a mix and source add their weights and keep the larger `max_repeats`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skygrain.functions.prefix import running_total
from skygrain.llm.bpe import DEFAULT_VOCABULARY, spread, tokens_of
from skygrain.sources.scratch import written

BLOCK, LEAST_SLOTS = 2048, 4096
GOLDEN = 0.6180339887498949
STEPS, CHUNK_SLOTS, CHUNK_DOCS = 1024, 65_536, 65_536


def sized(docs: DataFrame, key: str, text: str, source: str, listed: DataFrame | None = None, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc, source, tokens) of the documents with a source, of those in `listed` (column source) if given; written once."""
    rows = spread(docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.col(source).alias("source"))).filter("source is not null")
    if listed is not None:
        rows = rows.join(listed, "source", "left_semi")
    return written(rows.select("doc", "source", tokens_of(docs.sparkSession, path)(F.col("text")).cast("long").alias("tokens")), "sized")


def discrepancy(n_slots: Column) -> Column:
    """Slots by which the schedule may miss a source's share of `n_slots`, at most."""
    return F.lit(3.0) + F.log(F.greatest(F.lit(1), n_slots))


def wanted(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: tokens, max_repeats, weight and share; size, block and slots of the mix; blocks of the stream."""
    t = targets.filter("mix_id is not null and source is not null and weight > 0 and not isnan(weight)")
    t = t.groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    mix = Window.partitionBy("mix_id")
    t = t.join(have, "source", "left").fillna(0, ["tokens"])
    t = t.withColumns({"share": F.col("weight") / F.sum("weight").over(mix), "size": F.sum("tokens").over(mix)})
    t = t.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("size") / LEAST_SLOTS))))
    return t.withColumns({"n_slots": F.ceil(F.col("size") / F.col("block")), "n_blocks": F.floor(F.col("tokens") * F.greatest(F.lit(0), F.col("max_repeats")) / F.col("block"))})


def placed(sizes: DataFrame) -> DataFrame:
    """(doc, source, tokens, before): where each document lies in its source's shuffled stream."""
    # A chunk is a range of hashes, so chunks are as even as the hash; a source has as many as its documents ask for.
    parts = sizes.groupBy("source").agg(F.ceil(F.count("*") / CHUNK_DOCS).alias("parts"))
    mixed = sizes.withColumn("shuffled", F.xxhash64("doc", F.lit(11))).join(parts, "source")
    chunk = F.floor((F.col("shuffled").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * F.col("parts"))
    return running_total(mixed, ["source"], chunk, ["shuffled", "doc"], F.col("tokens"), "before").select("doc", "source", "tokens", "before")


def _taken(numbered: DataFrame, sources: DataFrame) -> DataFrame:
    """(mix_id, slot, source, k): slots with their number j through the weights of `sources`, k counting a source's own."""
    mix, upto = Window.partitionBy("mix_id"), Window.partitionBy("mix_id").orderBy("source")
    s = sources.withColumn("part", F.col("weight") / F.sum("weight").over(mix)).withColumn("high", F.sum("part").over(upto))
    last = F.row_number().over(Window.partitionBy("mix_id").orderBy(F.desc("source"))) == 1
    s = s.withColumns({"low": F.coalesce(F.lag("high").over(upto), F.lit(0.0)), "high": F.when(last, F.lit(1.0)).otherwise(F.col("high"))})
    points = numbered.withColumn("u", F.pmod((F.col("j") + 0.5) * F.lit(GOLDEN), F.lit(1.0))).withColumn("step", F.floor(F.col("u") * STEPS))
    # A point meets the one or two intervals that reach into its step, not every source of the mix.
    lists = s.select("mix_id", "source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * STEPS), F.floor(F.col("high") * STEPS))).alias("step"))
    taken = points.join(lists, ["mix_id", "step"]).filter("u >= low and u < high").select("mix_id", "source", "slot")
    return running_total(taken, ["mix_id", "source"], F.floor(F.col("slot") / CHUNK_SLOTS), ["slot"], F.lit(1).cast("long"), "k")


def _numbered(plan: DataFrame) -> DataFrame:
    """(mix_id, slot, j) of every slot, j equal to slot."""
    mixes = plan.select("mix_id", "n_slots").distinct().filter("n_slots > 0")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / CHUNK_SLOTS))).alias("part")
    slots = mixes.select("mix_id", "n_slots", part).select("mix_id", F.explode(F.expr(f"sequence(part * {CHUNK_SLOTS}, least(n_slots, (part + 1) * {CHUNK_SLOTS}) - 1)")).alias("slot"))
    return slots.withColumn("j", F.col("slot"))


def schedule(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, slots): slots has mix_id, slot, source, k, turn and filled.

    Turn 0 holds every slot with the source whose share it is; later turns hold the slots that were still empty, with the
    source asked to fill them. A slot is filled in one turn at most.
    """
    plan = written(wanted(sizes, targets), "mix-plan")
    left = plan.select("mix_id", "source", "weight", "n_blocks", F.lit(0).cast("long").alias("used"))
    open_, turns, turn = _numbered(plan), None, 0
    while True:
        taken = _taken(open_, left.select("mix_id", "source", "weight")).join(left.select("mix_id", "source", "n_blocks", "used"), ["mix_id", "source"])
        taken = taken.withColumn("k", F.col("k") + F.col("used")).withColumn("filled", F.col("k") < F.col("n_blocks"))
        taken = written(taken.select("mix_id", "slot", "source", "k", F.lit(turn).alias("turn"), "filled"), "slots")
        turns = taken if turns is None else turns.unionByName(taken)
        now = taken.filter("filled").groupBy("mix_id", "source").agg(F.count("*").alias("more"))
        left = left.join(now, ["mix_id", "source"], "left").withColumn("used", F.col("used") + F.coalesce("more", F.lit(0))).drop("more")
        # Each turn exhausts a source or fills all slots, so there are fewer turns than sources of a mix.
        left = written(left.filter("used < n_blocks"), "sources-left")
        empty = taken.filter(~F.col("filled")).select("mix_id", "slot").join(left.select("mix_id").distinct(), "mix_id", "left_semi")
        if empty.isEmpty():
            return plan, turns
        open_ = running_total(empty, ["mix_id"], F.floor(F.col("slot") / CHUNK_SLOTS), ["slot"], F.lit(1).cast("long"), "j")
        turn += 1


def drawn(plan: DataFrame, slots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(mix_id, slot, source, doc, repetition, from_token, tokens): what the filled slots draw, in tokens of each document."""
    filled = slots.filter("filled").select("mix_id", "slot", "source", "k")
    used = filled.groupBy("mix_id", "source").agg(F.count("*").alias("used"))
    streams = plan.join(used, ["mix_id", "source"]).select("mix_id", "source", "block", "used", F.col("tokens").alias("length"))
    docs = placed(sizes).filter("tokens > 0").join(streams, "source")
    docs = docs.withColumn("repetition", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("used") * F.col("block") - 1) / F.col("length")))))
    docs = docs.withColumn("start", F.col("repetition") * F.col("length") + F.col("before"))
    reach = F.least(F.floor((F.col("start") + F.col("tokens") - 1) / F.col("block")), F.col("used") - 1)
    docs = docs.withColumn("first", F.floor(F.col("start") / F.col("block"))).filter(F.col("first") < F.col("used")).withColumn("k", F.explode(F.sequence("first", reach)))
    begin = F.greatest(F.col("start"), F.col("k") * F.col("block"))
    end = F.least(F.col("start") + F.col("tokens"), (F.col("k") + 1) * F.col("block"))
    parts = docs.select("mix_id", "source", "k", "doc", "repetition", (begin - F.col("start")).alias("from_token"), (end - begin).alias("tokens"))
    return filled.join(parts, ["mix_id", "source", "k"]).drop("k")


def report(plan: DataFrame, slots: DataFrame) -> DataFrame:
    """Per mix and source: target and reached share, slots wanted and filled, and whether the source falls short.

    A source falls short if more of its slots stay empty than the schedule may miss; where fewer do, or few blocks are
    left over, its exact tokens decide.
    """
    asked = slots.filter("turn = 0").groupBy("mix_id", "source").agg(F.count("*").alias("slots_wanted"))
    got = slots.filter("filled").groupBy("mix_id", "source").agg(F.count("*").alias("slots_filled"), F.count_if(F.col("turn") > 0).alias("slots_for_others"))
    out = plan.join(asked, ["mix_id", "source"], "left").join(got, ["mix_id", "source"], "left").fillna(0, ["slots_wanted", "slots_filled", "slots_for_others"])
    cap = F.col("tokens") * F.col("max_repeats")
    gap, sure = F.col("slots_wanted") - cap / F.col("block"), discrepancy(F.col("n_slots"))
    short = F.when(gap > sure, True).when(gap < -sure, False).otherwise(cap < F.col("share") * F.col("size"))
    tokens = F.col("slots_filled") * F.col("block")
    total = F.sum(tokens).over(Window.partitionBy("mix_id"))
    return out.select(
        "mix_id", "source", "tokens", "max_repeats", "size", "block", "n_slots", F.col("share").alias("target_share"), F.when(total > 0, tokens / total).alias("actual_share"),
        "slots_wanted", "slots_filled", "slots_for_others", tokens.alias("drawn_tokens"), short.alias("short"),
    )

"""Mixing sources to target weights (native).

Each source is one stream of words, its documents in a fixed pseudorandom order,
cut into blocks of ``block_words``; the last block may be short.  Every output
shard has ``shard_slots`` slots and draws its source counts from a multinomial
with the targets as probabilities.  A source's draws are numbered over all shards;
draws beyond its quota go to sources that stay below theirs, so totals are exact
while shards vary as drawn.  Slot k of a source belongs to pass ``k div blocks``,
and a pseudorandom permutation keyed by source and pass maps it to a block; slots
and blocks then meet in a join on (source, block).

The permutation is a swap-or-not shuffle, which is a bijection of [0, n) for any n
and needs no table.  A pass uses every block once, so a target of at most twice a
source's size takes no word more than twice.

Edge cases: a null text has no words and is returned with 0 taken; a null source is
a source of its own, after all others; repeated rows are separate documents; an
empty table, or one without words, gives targets of 0; only the named columns are
read.  The same rows give the same mix in any run and any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running_offsets, running_sum, stash, uniform

#: Rounds of the swap-or-not shuffle.
ROUNDS = 12
#: Slots that one task draws or permutes.
SLOTS_PER_TASK = 100_000


def source_plan(
    rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 64
) -> DataFrame:
    """One row per source: rank, size, target, and what the slots need.

    Targets share ``share`` times all words by weight and stop at ``most`` times the
    source's size, the excess going to the others by weight.  With the sources in the
    order of cap by weight, the level at which all would be equal is the largest
    (rest of the total) / (rest of the weights), so no iteration is needed.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.select("*", (F.row_number().over(by_name) - 1).alias("rank"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("rank") % len(weights) + 1)
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum(
        "w"
    ).over(later)
    filled = ranked.withColumn("level", level)
    target = F.least(F.col("cap"), F.col("w") * F.max("level").over(everyone))
    size, length = F.col("source_size"), F.lit(block_words).cast("long")
    quota = F.round("target").cast("long")
    return (
        filled.withColumn("target", F.when(size > 0, target).otherwise(F.lit(0.0)))
        .withColumn("passes", F.when(size > 0, F.floor(quota / size)).otherwise(0).cast("long"))
        .withColumn("rest", F.when(size > 0, quota - F.col("passes") * size).otherwise(0).cast("long"))
        .withColumn("full", F.floor(size / length).cast("long"))
        .withColumn("blocks", F.ceil(size / length).cast("long"))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / length).cast("long"))
        .select("source", "rank", "source_size", "target", "passes", "rest", "full", "blocks", "slots")
    )


def multinomial_counts(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(rank, shard, first, n): shard's draws of a source are its slots first .. first + n - 1."""
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = plan.select("rank", F.sum("slots").over(upto).alias("end")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "end"))), lambda x: x["end"] / F.lit(float(max(total, 1)))).alias("ends")
    )
    n_shards = -(-total // shard_slots)
    drawn = (
        spark.range(0, n_shards, 1, max(1, total // SLOTS_PER_TASK))
        .select(
            F.col("id").alias("shard"),
            F.explode(F.sequence(F.lit(0), F.least(F.lit(shard_slots), F.lit(total) - F.col("id") * shard_slots).cast("int") - 1)).alias("i"),
        )
        .withColumn("u", uniform(F.lit(f"draw {seed}"), F.col("shard"), F.col("i")))
        .withColumn("ends", ends.scalar())
        .withColumn("rank", F.size(F.filter("ends", lambda e: e <= F.col("u"))))
        .groupBy("rank", "shard")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    numbered = running_sum(stash(drawn, "drawn"), ["rank"], "shard", "n", "first").join(plan.select("rank", "slots"), "rank")
    held = numbered.withColumn("held", F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.col("first"))))
    held = stash(held, "draws")
    over = held.where(F.col("n") > F.col("held"))
    # few rows: a source's draws pass its quota by some standard deviations, in its last shards
    running = Window.orderBy("shard", "rank").rowsBetween(Window.unboundedPreceding, -1)
    over = over.withColumn("more", F.col("n") - F.col("held")).withColumn("base", F.coalesce(F.sum("more").over(running), F.lit(0)))
    zero = F.lit(0).cast("long")
    over = over.select("shard", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("more") - 1)).alias("unit"))
    have = held.groupBy("rank").agg(F.sum("held").alias("have"))
    short = plan.join(have, "rank", "left").select("rank", F.coalesce("have", zero).alias("have"), "slots").where("slots > have")
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("less", F.col("slots") - F.col("have")).withColumn("base", F.coalesce(F.sum("less").over(by_rank), zero))
    short = short.select("rank", "have", "base", F.explode(F.sequence(zero, F.col("less") - 1)).alias("j")).select(
        "rank", (F.col("have") + F.col("j")).alias("first"), (F.col("base") + F.col("j")).alias("unit")
    )
    moved = over.join(short, "unit").select("rank", "shard", "first", F.lit(1).cast("long").alias("n"))
    return held.where("held > 0").select("rank", "shard", "first", F.col("held").alias("n")).unionByName(moved)


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The image of ``x`` under a pseudorandom permutation of [0, n) that ``key`` chooses."""

    def turn(acc: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit("k"), *key, r) - acc, n)
        swap = F.xxhash64(F.lit("b"), *key, r, F.greatest(acc, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), turn)


def slot_table(plan: DataFrame, counts: DataFrame, block_words: int, seed: int) -> DataFrame:
    """(rank, block, shard, slot, turn, take): the words 0 .. take - 1 of a block go into a shard."""
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    spread = counts.repartition(max(1, total // SLOTS_PER_TASK), "rank", "shard")
    one = spread.join(plan.select("rank", "passes", "rest", "full", "blocks"), "rank").select(
        "*", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")
    )
    turn = F.least(F.floor(F.col("slot") / F.col("blocks")).cast("long"), F.col("passes"))
    one = one.withColumn("turn", turn).withColumn("j", F.col("slot") - F.col("turn") * F.col("blocks"))
    block = F.when(F.col("j") >= F.col("full"), F.col("j")).otherwise(
        permuted(F.col("j"), F.col("full"), F.lit(seed), F.col("rank"), F.col("turn"))
    )
    length = F.lit(block_words).cast("long")
    take = F.when(F.col("turn") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("j") * length))
    return one.select("rank", block.alias("block"), "shard", "slot", "turn", take.alias("take"))


def block_pieces(rows: DataFrame, block_words: int) -> DataFrame:
    """Cut rows (rank, at, size, ...) into (rank, block, from, to): word positions inside each block."""
    length = F.lit(block_words).cast("long")
    first, last = F.floor(F.col("at") / length).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / length).cast("long")
    return (
        rows.where("size > 0")
        .select("*", F.explode(F.sequence(first, last)).alias("block"))
        .withColumn("from", F.greatest(F.lit(0).cast("long"), F.col("at") - F.col("block") * length))
        .withColumn("to", F.least(length, F.col("at") + F.col("size") - F.col("block") * length))
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 64,
    shard_slots: int = 4096,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of all documents, as three tables.

    ``rows``: row (a number), doc_id, source, size, text_hash, rank, at (place in its source's
    stream), source_size, target.  ``slots``: rank, block, shard, slot, turn, take.  ``pieces``: the join of blocks
    and slots: doc columns, shard, slot, turn, and the words ``from`` .. ``upto`` - 1 of the block.
    """
    if not share < most or most > 2:
        raise ValueError("share must be below most, and most at most 2")
    sized = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    sized = stash(sized, "sizes")
    plan = stash(source_plan(sized, weights, share, most, block_words), "sources")
    known = plan.select(F.col("source").alias("s"), "rank", "source_size", "target")
    rows = sized.join(known, sized["source"].eqNullSafe(known["s"])).drop("s")
    rows = stash(running_offsets(rows, "rank", ["doc_id", "size", "text_hash"], "size", "at"), "places")
    slots = slot_table(plan, multinomial_counts(plan, shard_slots, seed), block_words, seed)
    pieces = (
        block_pieces(rows, block_words)
        .join(slots, ["rank", "block"])
        .withColumn("upto", F.least("to", "take"))
        .where(F.col("upto") > F.col("from"))
        .drop("to", "take")
    )
    return rows, slots, pieces


def taken_words(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per document of ``rows``: with taken and n_slots (slots it has words in)."""
    got = pieces.groupBy("row").agg(F.sum(F.col("upto") - F.col("from")).alias("got"), F.count(F.lit(1)).alias("slots"))
    zero = F.lit(0).cast("long")
    return rows.join(got, "row", "left").select(
        "row", "doc_id", "source", "size", "rank", "at", "source_size", "target", F.coalesce("got", zero).alias("taken"), F.coalesce("slots", zero).alias("n_slots")
    )


def mixed_documents(
    docs: DataFrame,
    rows: DataFrame,
    pieces: DataFrame,
    block_words: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix as documents: one row per document and pass, its text being the words that pass takes.

    A pass that takes a whole document keeps its text as it is; else the taken runs of words
    are joined by spaces, in order.  The other columns of ``docs`` are kept; rows that are equal
    in id, source and text get the spans of all of them from one.
    """
    start = F.col("block") * block_words + F.col("from") - F.col("at")
    spans = pieces.groupBy("doc_id", "source", "text_hash", "rank", "at", "size", "turn").agg(
        F.array_sort(F.collect_list(F.struct(start.cast("int").alias("first"), (F.col("upto") - F.col("from")).cast("int").alias("n")))).alias("spans"),
        F.sum(F.col("upto") - F.col("from")).alias("taken"),
    )
    spans = spans.select(*[F.col(c).alias(f"__{c}") for c in spans.columns])
    one = docs.withColumn("__hash", F.xxhash64(F.col(text_col)))
    if rows.groupBy("doc_id", "source", "text_hash").count().where("count > 1").limit(1).count():
        one = one.dropDuplicates([id_col, source_col, "__hash"])  # equal rows get all their spans from one
    joined = one.join(
        spans,
        one[id_col].eqNullSafe(spans["__doc_id"]) & one[source_col].eqNullSafe(spans["__source"]) & (one["__hash"] == spans["__text_hash"]),
    )
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
    some = joined.withColumn("__words", F.when(F.col("__taken") < F.col("__size"), words))
    parts = F.transform("__spans", lambda x: F.array_join(F.slice("__words", x["first"] + 1, x["n"]), " "))
    text = F.when(F.col("__taken") < F.col("__size"), F.array_join(parts, " ")).otherwise(F.col(text_col))
    return some.withColumn(text_col, text).select(*docs.columns)

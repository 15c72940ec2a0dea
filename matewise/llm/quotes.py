"""Quotation linking for chat and mail threads (native).

A line's quote level is the number of ``>`` marks before its text.  A passage is a run
of non-blank lines of one level; it is normalised (marks off, lower case, white space
runs to one space) and hashed with MD5.  The level-0 passages of messages are the
originals; a quoted passage belongs to the first message of its conversation, before
the quoting one, that holds it unquoted.  A message replies to the message most of its
level-1 passages come from (the later one if tied), else the most of any level, else
to the message before it.

Conversations come back without quotes, in reply order: depth first, a message's replies by
turn.  As a message without a link follows the one before it, the messages from one link to
the next are a segment that stays together, and only segments form a tree: behind a segment
come those that reply into it, the last message replied to first.  Their places come from
ranking the tour around that tree by pointer jumping.

Originals are reduced to one row per conversation and hash before the join.  Messages are
numbered over ranges of their order, so one conversation, turn or passage with a third of all
rows spreads over many tasks.

Edge cases: a null text has an empty body and quotes nothing; a null conversation id
is a conversation of its own kind (all such rows together); a null turn sorts first and
is never replied to; rows that repeat conversation, turn, role and text are one message
with ``copies``; messages with equal turns keep the order of role and text, and a reply to
their turn is one to the first of them; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash

MARKS = r"^[ \t]*(>[ \t]?)+"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"[ \t\r\n\f\x0B]+", " "))


def passages(lines: Column, at: Column) -> Column:
    """Hashes of the passages of one level, in order."""
    only = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == at, x["text"]).otherwise(F.lit(""))), "\n")
    parts = F.transform(F.split(only, r"\n[ \t\r]*\n"), normalised)
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.md5(x.cast("binary")))


def parse(chats: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per message: conv, turn, role, text, copies, body, levels, own (hashes), quoted (level, hashes)."""
    rows = chats.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("text"))
    )
    rows = rows.withColumn("lines", lines)
    body = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"]), "\n"))
    rows = rows.withColumn("body", body).withColumn("levels", F.array_max(F.transform("lines", lambda x: x["level"])))
    quoted = F.when(
        F.col("levels") > 0,
        F.transform(F.sequence(F.lit(1), F.col("levels")), lambda k: F.struct(k.alias("level"), passages(F.col("lines"), k).alias("prints"))),
    )
    return rows.withColumn("own", passages(F.col("lines"), F.lit(0))).withColumn("quoted", quoted).drop("lines")


def quotations(messages: DataFrame) -> DataFrame:
    """One row per quoted passage: conv, turn, role, text_key, level, print, original (turn, or null)."""
    firsts = (
        messages.where("turn IS NOT NULL")
        .select(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("c"), F.col("conv").isNull().alias("cn"), "turn", F.explode("own").alias("print"))
        .groupBy("c", "cn", "print")
        .agg(F.min("turn").alias("original"))
    )
    asked = (
        messages.where("levels > 0")
        .select("conv", "turn", "key", F.explode("quoted").alias("q"))
        .select("conv", "turn", "key", "q.level", F.explode("q.prints").alias("print"))
        .withColumn("c", F.coalesce(F.col("conv").cast("string"), F.lit("")))
        .withColumn("cn", F.col("conv").isNull())
    )
    # a key that the aggregation is not partitioned by, so a passage that a third of all messages quote can be split
    key = ["c", "cn", "turned"]
    firsts = firsts.select("c", "cn", F.reverse("print").alias("turned"), "original")
    found = asked.withColumn("turned", F.reverse("print")).join(firsts, key, "left")
    return found.select(
        "conv", "turn", "key", "level", "print", F.when(F.col("original") < F.col("turn"), F.col("original")).alias("original")
    )


def threads(
    chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The messages, numbered in reply order, and their quotations.

    Messages: conv, turn, role, body, copies, n_quotes, n_linked, levels, reply_to (turn),
    link ('quote', 'previous', 'start'), root (turn where its chain of quotes starts),
    position (from 0 within the conversation, in reply order).
    """
    messages = parse(chats, conv, turn, role, text)
    messages = messages.withColumn("key", F.md5(F.concat_ws("\x01", F.coalesce("role", F.lit("\x02")), F.coalesce("text", F.lit("\x02"))).cast("binary")))
    messages = stash(messages.drop("text"), "messages")
    quotes = stash(quotations(messages), "quotes")
    votes = quotes.where("original IS NOT NULL").groupBy("conv", "turn", "key", "original").agg(
        F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).alias("direct"), F.count(F.lit(1)).alias("n")
    )
    replies = votes.groupBy("conv", "turn", "key").agg(
        F.max_by("original", F.struct("direct", "n", "original")).alias("original"), F.sum("n").alias("n_linked")
    )
    made = quotes.groupBy("conv", "turn", "key").agg(F.count(F.lit(1)).alias("n_quotes"))
    replies = stash(_with(made, replies), "replies")
    roots = chain_roots(replies.where("original IS NOT NULL").groupBy("conv", "turn").agg(F.min("original").alias("to")))
    # numbered without their texts, which are shuffled for the last join alone
    placed = numbered(in_ranges(messages.select("conv", "turn", "role", "key"), [F.col(c) for c in ("conv", "turn", "role", "key")], "order"))
    placed = reply_order(stash(_with(placed.drop("role"), replies), "numbered"))
    placed = placed.join(roots, placed["conv"].eqNullSafe(roots["r_conv"]) & (placed["turn"] == roots["r_turn"]), "left")
    placed = placed.select("conv", "turn", "key", "n_quotes", "n_linked", "original", "before", "root", "position")
    out = _with(messages.select("conv", "turn", "key", "role", "body", "copies", "levels"), placed)
    out = out.select(
        "conv",
        "turn",
        "role",
        "body",
        "copies",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "levels",
        F.coalesce("original", "before").alias("reply_to"),
        F.when(F.col("original").isNotNull(), "quote").when(F.col("before").isNotNull(), "previous").otherwise("start").alias("link"),
        F.coalesce("root", "turn").alias("root"),
        "position",
    )
    return out, quotes


def conversations(messages: DataFrame, most: int = 256) -> DataFrame:
    """Messages of :func:`threads` put together: conv, part, n_messages, text.

    A part is up to ``most`` messages in reply order, each as its role and body; a longer
    conversation goes on in the next part, so no row and no task grows with a conversation.
    """
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), "body")
    parts = messages.select("conv", F.floor(F.col("position") / most).alias("part"), F.struct("position", line.alias("line")).alias("m"))
    parts = parts.groupBy("conv", "part").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return parts.select("conv", "part", F.size("ms").alias("n_messages"), F.array_join("ms.line", "\n\n").alias("text"))


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on conv, turn and key, nulls being equal."""
    names = ["conv", "turn", "key"]
    other = right.select(*[F.col(c).alias(f"__{c}") for c in names], *[c for c in right.columns if c not in names])
    on = left["key"] == other["__key"]
    for c in names[:2]:
        on &= left[c].eqNullSafe(other[f"__{c}"])
    return left.join(other, on, "left").drop(*[f"__{c}" for c in names])


def chain_roots(links: DataFrame) -> DataFrame:
    """(r_conv, r_turn, root): where each message's chain of quotes ends, by pointer jumping.

    Targets are always earlier turns, so chains end; each round halves what is left of them.
    """
    now = stash(links.select("conv", "turn", "to"), "chains")
    while True:
        up = now.select(F.col("conv").alias("u_conv"), F.col("turn").alias("u_turn"), F.col("to").alias("up"))
        jumped = now.join(up, now["conv"].eqNullSafe(up["u_conv"]) & (now["to"] == up["u_turn"]), "left")
        jumped = stash(jumped.select("conv", "turn", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved")), "chains")
        discard(now)
        now = jumped.drop("moved")
        if not jumped.where("moved").limit(1).count():
            return now.select(F.col("conv").alias("r_conv"), F.col("turn").alias("r_turn"), F.col("to").alias("root"))


def in_ranges(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``rows`` written in ranges of ``order``, numbered by ``range``: groups of equal first columns may span several."""
    return stash(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), label)


def numbered(messages: DataFrame) -> DataFrame:
    """Messages (in ranges) with place (from 0 by turn, role, key) and before (the turn of the message before)."""
    ends = messages.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    ranges = Window.partitionBy("conv").orderBy("range")  # a row for each range at most
    ends = ends.select(
        F.col("conv").alias("e_conv"),
        F.col("range").alias("e_range"),
        F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.lag("last").over(ranges).alias("last_before"),
    )
    rows = messages.join(ends, messages["conv"].eqNullSafe(ends["e_conv"]) & (messages["range"] == ends["e_range"]))
    order = Window.partitionBy("conv", "range").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "key")
    number = F.row_number().over(order)
    before = F.when(number == 1, F.col("last_before")).otherwise(F.lag("turn").over(order))
    return rows.withColumns({"place": F.col("base") + number - 1, "before": before}).drop("e_conv", "e_range", "base", "last_before")


def reply_order(rows: DataFrame) -> DataFrame:
    """Add position to rows (conv, range, turn, key, place, original)."""
    head = F.when(F.col("original").isNotNull() | (F.col("place") == 0), F.col("place"))
    tops = rows.groupBy("conv", "range").agg(F.max(head).alias("top"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("conv").alias("t_conv"), F.col("range").alias("t_range"), F.max("top").over(earlier).alias("top"))
    upto = Window.partitionBy("conv", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.join(tops, rows["conv"].eqNullSafe(tops["t_conv"]) & (rows["range"] == tops["t_range"]))
    cut = cut.withColumn("start", F.coalesce(F.max(head).over(upto), "top")).drop("t_conv", "t_range", "top")
    cut = stash(cut, "segmented")
    order = tour_places(cut)
    moved = F.coalesce(F.col("begin") + F.col("place") - F.col("start"), F.col("place"))
    return cut.join(order, cut["conv"].eqNullSafe(order["o_conv"]) & (cut["start"] == order["o_start"]), "left").withColumn("position", moved)


def tour_places(cut: DataFrame) -> DataFrame:
    """(o_conv, o_start, begin): where segments begin in reply order, for conversations of several segments."""
    sizes = cut.groupBy("conv", "start").agg(F.count(F.lit(1)).alias("n"))
    heads = cut.where("original IS NOT NULL AND place > 0").select(F.col("conv").alias("h_conv"), F.col("start").alias("h_start"), "original")
    at = cut.where("turn IS NOT NULL").select("conv", "turn", "place", F.col("start").alias("up_start"))
    into = heads.join(at, heads["h_conv"].eqNullSafe(at["conv"]) & (heads["original"] == at["turn"]))
    into = into.groupBy("h_conv", "h_start").agg(F.min(F.struct("place", "up_start")).alias("to"))
    several = into.select(F.col("h_conv").alias("s_conv")).distinct()
    some = sizes.join(several, sizes["conv"].eqNullSafe(several["s_conv"]), "left_semi")
    some = some.join(into, some["conv"].eqNullSafe(into["h_conv"]) & (some["start"] == into["h_start"]), "left")
    some = some.select("conv", "start", "n", F.col("to.place").alias("into"), F.col("to.up_start").alias("up_start"))
    some = stash(some.withColumn("id", F.monotonically_increasing_id()), "segments")
    ups = some.select(F.col("conv").alias("u_conv"), F.col("start").alias("u_start"), F.col("id").alias("up"))
    tree = some.join(ups, some["conv"].eqNullSafe(ups["u_conv"]) & (some["up_start"] == ups["u_start"]), "left")
    tree = in_ranges(tree.select("conv", "start", "n", "id", "up", "into"), [F.col("up"), F.desc("into"), F.col("start")], "tree")
    # the next reply into the same segment
    order = Window.partitionBy("range", "up").orderBy(F.desc("into"), "start")
    across = tree.where("up IS NOT NULL").groupBy("range", "up").agg(F.min(F.struct(-F.col("into"), "start", "id")).alias("first"))
    ranges = Window.partitionBy("up").orderBy("range")
    across = across.select(F.col("range").alias("a_range"), F.col("up").alias("a_up"), F.lead("first.id").over(ranges).alias("across"))
    tree = tree.join(across, (tree["range"] == across["a_range"]) & (tree["up"] == across["a_up"]), "left")
    tree = stash(tree.withColumn("next", F.when(F.col("up").isNotNull(), F.coalesce(F.lead("id").over(order), "across"))), "siblings")
    below = tree.where("up IS NOT NULL").groupBy(F.col("up").alias("b_id")).agg(F.min(F.struct(-F.col("into"), "start", "id")).alias("first"))
    # each segment is entered (2 id) and left (2 id + 1)
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    tour = tree.join(below, tree["id"] == below["b_id"], "left").select(
        F.explode(
            F.array(
                F.struct(enter.alias("e"), F.coalesce(F.col("first.id") * 2, leave).alias("to"), F.col("n").alias("rest")),
                F.struct(leave.alias("e"), F.coalesce(F.col("next") * 2, F.col("up") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("rest")),
            )
        ).alias("x")
    )
    now = stash(tour.select("x.*"), "tour")
    while now.where("to IS NOT NULL").limit(1).count():
        ahead = now.select(F.col("e").alias("a"), F.col("to").alias("a_to"), F.col("rest").alias("a_rest"))
        jumped = now.join(ahead, now["to"] == ahead["a"], "left").select("e", F.col("a_to").alias("to"), (F.col("rest") + F.coalesce("a_rest", F.lit(0))).alias("rest"))
        last, now = now, stash(jumped, "tour")
        discard(last)
    whole = tree.groupBy("conv").agg(F.sum("n").alias("all")).select(F.col("conv").alias("w_conv"), "all")
    placed = tree.join(now, now["e"] == tree["id"] * 2)
    placed = placed.join(whole, placed["conv"].eqNullSafe(whole["w_conv"]))
    return placed.select(F.col("conv").alias("o_conv"), F.col("start").alias("o_start"), (F.col("all") - F.col("rest")).alias("begin"))

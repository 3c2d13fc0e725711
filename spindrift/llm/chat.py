"""Chat formatting by quotation linking, with DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, cut, discard, scope

QUOTE = r"^(?:[ \t]*>)+"
#: How a line that announces a quotation ends.
ATTRIBUTION = r"(wrote|writes|said|schrieb|écrit|escribió)[ \t]*:[ \t]*$"
BLOCK = 1024  # turns that one task orders at a time


def normalised(passage: Column) -> Column:
    """Lower case (A-Z), single spaces, none at the ends."""
    return F.trim(F.regexp_replace(ascii_lower(passage), f"{SPACE}+", " "))


def parsed(text: Column) -> Column:
    """The lines of a message as (level, body): how many ``>`` a line starts with, and what follows."""
    line = lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, QUOTE, "").alias("body"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def content(lines: Column) -> Column:
    """A message without quoted lines and without the lines that announce them, outer white space cut."""

    def own(x: Column) -> Column:
        announces = lambda y, i: y["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(x, i + 1)["level"], F.lit(0)) > 0)
        return F.array_join(F.array_compact(F.transform(x, lambda y, i: F.when((y["level"] == 0) & ~announces(y, i), y["body"]))), "\n")

    return F.regexp_replace(F.transform(F.array(lines), own)[0], f"^{SPACE}+|{SPACE}+$", "")


def passages(lines: Column) -> Column:
    """Distinct (level, passage): every line, and every run of lines of one level, normalised, none empty."""

    def runs(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["level"] != F.get(x, F.greatest(i - 1, F.lit(0)))["level"]))
        cut = lambda b: F.transform(b, lambda s, k: F.struct(F.get(x, s)["level"].alias("level"), normalised(F.array_join(F.transform(F.slice(x, s + 1, F.coalesce(F.get(b, k + 1), F.size(x)) - s), lambda y: y["body"]), " ")).alias("passage")))
        return F.transform(F.array(starts), cut)[0]

    single = F.transform(lines, lambda y: F.struct(y["level"].alias("level"), normalised(y["body"]).alias("passage")))
    both = F.concat(F.transform(F.array(lines), runs)[0], single)
    return F.array_distinct(F.filter(both, lambda p: p["passage"] != ""))


def quote_links(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv, turn, origin: for each message whose quotation is found, the turn it replies to.

    A passage belongs to the first message of its conversation that holds it as its own. Of the
    earlier messages that a message quotes, it replies to the one quoted at the lowest level, then
    with most words, then the latest.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("t")).where("conv is not null and turn is not null")
    quoting = rows.where(F.col("t").rlike(f"(?m){QUOTE}"))
    hashed = lambda p: F.sha2(p, 256)
    quoted = quoting.select("conv", "turn", F.explode(passages(parsed(F.col("t")))).alias("p")).where("p.level > 0")
    quoted = quoted.select("conv", "turn", "p.level", hashed(F.col("p.passage")).alias("hash"), F.size(F.split("p.passage", " ")).alias("words"))
    sources = rows.join(quoting.select("conv").distinct(), "conv", "left_semi").withColumn("lines", parsed(F.col("t")))
    whole = F.array(F.struct(F.lit(0).alias("level"), normalised(content(F.col("lines"))).alias("passage")))
    own = sources.select("conv", "turn", F.explode(F.concat(passages(F.col("lines")), whole)).alias("p")).where("p.level = 0 and p.passage <> ''")
    first = own.groupBy("conv", hashed(F.col("p.passage")).alias("hash")).agg(F.min("turn").alias("origin"))
    found = quoted.join(first, ["conv", "hash"]).where("origin < turn")
    scored = found.groupBy("conv", "turn", "origin").agg(F.min("level").alias("level"), F.sum("words").alias("words"))
    return scored.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "words", "origin")).alias("best")).select("conv", "turn", "best.origin")


def _before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the greatest ``value`` of the conversation's earlier turns.

    A conversation may hold most rows, so turns are ordered in blocks; a block starts from the
    greatest value of the blocks before it.
    """
    within = Window.partitionBy("conv", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("conv", "block").agg(F.max(value).alias("top"))
    carried = tops.select("conv", "block", F.max("top").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return rows.withColumn(name, F.max(value).over(within)).join(carried, ["conv", "block"]).withColumn(name, F.coalesce(name, "carried")).drop("carried")


def _counted(turns: DataFrame) -> DataFrame:
    """``turns`` (one row per conv and turn, with block) with ``c``, how many turns of the conversation go up to it."""
    within = Window.partitionBy("conv", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    sizes = turns.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return turns.withColumn("c", F.count("*").over(within)).join(shifts, ["conv", "block"]).withColumn("c", F.col("c") + F.col("shift")).drop("shift")


def threads(turns: DataFrame) -> DataFrame:
    """``root`` and ``depth`` of each turn (conv, turn, block, reply_to, branch; one row each).

    Within a branch every message answers the one before it, so only the branches' first messages
    point anywhere else: each is led to the branch that it answers, and these steps are doubled
    until all have reached a root, in as many rounds as the logarithm of the deepest nesting.
    """
    numbered = _counted(turns)
    numbered = _before(numbered.withColumn("opens_at", F.when(F.col("turn") == F.col("branch"), F.col("c"))), "opens_at", "earlier")
    numbered = cut(numbered.withColumn("place", F.col("c") - F.coalesce("opens_at", "earlier")).select("conv", "turn", "reply_to", "branch", "place"), "turns")
    openers = numbered.where("turn = branch")
    led = openers.select("conv", F.col("branch").alias("o"), F.col("reply_to").alias("to")).where("to is not null").join(numbered.select("conv", F.col("turn").alias("to"), F.col("branch").alias("up"), (F.col("place") + 1).alias("steps")), ["conv", "to"])
    state = led.select("conv", "o", "up", "steps").unionByName(openers.where("reply_to is null").select("conv", F.col("branch").alias("o"), F.lit(None).cast("long").alias("up"), F.lit(0).cast("long").alias("steps")))
    state = cut(state.withColumn("root", F.when(F.col("up").isNull(), F.col("o"))), "openers")
    while not (todo := state.where("root is null")).isEmpty():
        above = state.select("conv", F.col("o").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("root").alias("top"))
        moved = todo.drop("root").join(above, ["conv", "up"]).select("conv", "o", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("top").alias("root"))
        old, state = state, cut(state.where("root is not null").unionByName(moved), "openers")
        discard(old)
    found = numbered.join(state.select("conv", F.col("o").alias("branch"), "steps", "root"), ["conv", "branch"])
    return cut(found.select("conv", "turn", "root", (F.col("steps") + F.col("place")).alias("depth")), "threads", outer=1)


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message of the conversations, which ``in_reply_order`` sorts.

    Returns the three key columns, ``content`` (the message without quotations), ``n_quoted``
    (quoted lines), ``quote_depth`` (most nested level), ``linked`` (its quotation was found),
    ``reply_to`` (the turn it answers: that of the original it quotes, else the turn before),
    ``branch``: a message that answers another turn than the one before opens a branch, named by
    its own turn, which runs until the next; the first turn opens the first. ``root`` is the turn
    that a message leads back to by answers, and ``depth`` in how many of them, so the message's
    place in its conversation.

    Null texts are empty messages; very long ones are parsed whole. Messages with one turn number
    share their links, branch and place. Rows with a null conversation or turn stay, with no reply
    and no branch. Repeated rows stay, other columns, whatever their names, are left out, and no
    rows give none.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("t"))
    full = rows.where("conv is not null and turn is not null")
    with scope():
        keyed = full.select("conv", "turn").distinct().withColumn("block", F.floor(F.col("turn") / BLOCK))
        keyed = _before(keyed.join(quote_links(rows, "conv", "turn", "t"), ["conv", "turn"], "left"), "turn", "previous")
        keyed = keyed.withColumn("reply_to", F.coalesce("origin", "previous"))
        opens = F.col("previous").isNull() | (F.col("reply_to") != F.col("previous"))
        keyed = _before(keyed.withColumn("opened", F.when(opens, F.col("turn"))), "opened", "last_opened")
        keyed = cut(keyed.select("conv", "turn", "block", F.col("origin").isNotNull().alias("linked"), "reply_to", F.coalesce("opened", "last_opened").alias("branch")), "replies", outer=1)
        placed = keyed.drop("block").join(threads(keyed.drop("linked")), ["conv", "turn"])
    lines = lambda df: df.withColumn("lines", parsed(F.col("t")))
    level = F.transform("lines", lambda x: x["level"])
    clean = [content(F.col("lines")).alias("content"), F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"), F.coalesce(F.array_max(level), F.lit(0)).cast("long").alias("quote_depth")]
    done = lines(full).select("conv", "turn", "role", *clean).join(placed, ["conv", "turn"])
    none = [F.lit(None).cast("long").alias(c) for c in ("reply_to", "branch", "root", "depth")]
    rest = lines(rows.where("conv is null or turn is null")).select("conv", "turn", "role", *clean, F.lit(False).alias("linked"), *none)
    return done.select(*rest.columns).unionByName(rest).withColumnsRenamed({"conv": conv, "turn": turn, "role": role})


def in_reply_order(chats: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The messages of ``format_chats`` sorted by conversation, root, branch and turn, so that each
    stands after the one it answers. A long conversation runs through several partitions."""
    order = [conv, "root", "branch", turn]
    return chats.repartitionByRange(*order).sortWithinPartitions(*order)

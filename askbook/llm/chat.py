"""Chat formatting in budgeted windows, with DataFrame functions alone.

A turn is written "### role: text</turn>" and a line feed. Control strings inside roles and texts
are broken by a backslash, and their own backslashes doubled, so a text never holds a mark and reads
back exactly. Prefix sums of turn tokens cut a conversation into windows. What a window may hold of its own is the budget less `history`
and the conversation's first system turn. A turn of more than half the budget less `history` is a window of its own. The others belong to the window
in whose cell of the token axis they begin; cells are as wide as the longest of them leaves, so that the last one fits, too. A window
repeats the last turns before it, up to `history` tokens and to what the budget leaves, and the first system turn
if that came earlier. So no window passes the budget unless a single turn does, taken together with the system turn. Loss spans (code points of the
formatted text) cover the texts of assistant turns, except in repeated turns, so each is a target once.

Prefix sums are taken in two levels, blocks of turn numbers and then block totals, so one long
conversation is spread over many tasks; turns without a number are spread by role and first letters. A window's turns, of which the budget bounds the number, are
the only thing gathered. (Reading a conversation back as one digest gathers its text; that is for checks.)

Turns are in order of turn number, ties in order of role and text; equal rows are turns of their own. Null roles and
texts count as empty, null conv_id is a conversation, null turn numbers come first. Columns other than conv_id, turn,
role and text are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
#: A token is a run of ASCII letters and digits, or any other sign; each turn has some for its marks.
TOKEN, MARKS = r"[0-9A-Za-z_]+|[^0-9A-Za-z_ \t\n\r\f]", 4
BLOCK = 512
NO_BLOCK = -(1 << 62)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    marks = F.replace(doubled, F.lit("</turn>"), F.lit("<\\/turn>"))
    # From the end, so that a longer run of # does not end in three.
    return F.reverse(F.replace(F.reverse(marks), F.lit("###"), F.lit("##\\#")))


def unescape(text: Column) -> Column:
    marks = F.replace(F.replace(text, F.lit("#\\##"), F.lit("###")), F.lit("<\\/turn>"), F.lit("</turn>"))
    return F.replace(marks, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(":\\ "), F.lit(": ")))


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint") + MARKS


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """The turns with ord (place in the conversation), before (tokens ahead of it), window, ahead (the last window that may repeat it) and the system turn to retain.

    The system turn's text goes along only with turns that may begin a window, one of which a window's first turn is. Keys
    without nulls (conv, null_conv, block) deal the turns out once for the sums within blocks and the join of the blocks' offsets.
    """
    t = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = budget - history
    t = t.withColumn("tokens", tokens(F.col("text"))).withColumn("large", (F.col("tokens") > own // 2).cast("int"))
    # In the order of the turns, as turns without a number come first, in order of role and text.
    block = F.when(F.col("turn").isNull(), F.struct(F.lit(NO_BLOCK).alias("range"), F.col("role").alias("role"), F.substring("text", 1, 4).alias("head"))).otherwise(F.struct(F.expr(f"floor(turn / {BLOCK})").alias("range"), F.lit("").alias("role"), F.lit("").alias("head")))
    t = t.withColumn("block", block).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("null_conv", F.col("conv_id").isNull())
    conv = ["conv", "null_conv"]
    small = F.when(F.col("large") == 0, F.col("tokens"))
    sums = {"tokens": F.col("tokens"), "small": F.coalesce(small, F.lit(0)), "larges": F.col("large").cast("bigint"), "turns": F.lit(1).cast("bigint")}
    # Blocks are summed before they are dealt out, beside the turns themselves.
    first = F.min(F.when(F.col("role") == "system", F.struct("turn", "role", "text", "tokens")))
    blocks = t.groupBy(*conv, "block").agg(*[F.sum(c).alias(f"all_{n}") for n, c in sums.items()], F.max(small).alias("most"), first.alias("system"))
    along, whole = Window.partitionBy(*conv).orderBy("block").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*conv)
    offsets = blocks.select(*conv, "block", F.col("all_tokens"), *[(F.sum(f"all_{n}").over(along) - F.col(f"all_{n}")).alias(f"{n}_0") for n in sums], F.coalesce(F.max("most").over(whole), F.lit(0)).alias("most"), F.min("system").over(whole).alias("system"), F.lead("all_turns").over(Window.partitionBy(*conv).orderBy("block")).isNotNull().alias("goes_on"))
    here = Window.partitionBy(*conv, "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", *[(F.sum(c).over(here) - c).alias(f"{n}_in") for n, c in sums.items()])
    placed = t.join(offsets, [*conv, "block"]).select("*", *[(F.col(f"{n}_0") + F.col(f"{n}_in")).alias(f"{n}_before") for n in sums])
    room = F.lit(own) - F.coalesce("system.tokens", F.lit(0)) - F.col("most")
    placed = placed.withColumn("room", room).withColumn("cell", F.greatest(F.col("room"), F.lit(1)))
    # A system turn that leaves little room: every turn is a window of its own.
    alone = F.col("room") < own // 8
    placed = placed.withColumn("window", F.when(alone, 2 * F.col("turns_before") + 1).otherwise(F.expr("small_before div cell") + 2 * F.col("larges_before") + F.col("large")))
    near = Window.partitionBy(*conv, "block").orderBy("tokens_in")
    placed = placed.withColumn("begins", ~F.lag("window").over(near).eqNullSafe(F.col("window")))
    # Windows that begin up to `history` tokens on may repeat a turn. Past the block's end their numbers are bounded by how fast these can grow.
    grown = F.when(alone, F.lit(2 * (history // MARKS + 1))).otherwise(F.expr(f"{history} div cell") + 4)
    beyond = F.col("goes_on") & (F.col("tokens_in") + history >= F.col("all_tokens"))
    placed = placed.withColumn("ahead", F.when(beyond, F.col("window") + grown).otherwise(F.max("window").over(near.rangeBetween(0, history))))
    return placed.select(*conv, "conv_id", "turn", "role", "text", "tokens", F.col("turns_before").alias("ord"), F.col("tokens_before").alias("before"), "window", "ahead", F.coalesce("system.tokens", F.lit(0)).alias("system_tokens"), F.when(F.col("begins"), F.col("system")).alias("system"))


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """conv_id, window (rising, with gaps), first_turn, n_turns, n_repeated, formatted and loss_spans (start, length)."""
    if not 0 < 2 * history < budget:
        raise ValueError("history must be above zero and below half the budget")
    dealt = _placed(turns, budget, history)
    dealt = dealt.withColumn("to", F.explode(F.sequence("window", "ahead"))).withColumn("again", F.col("to") > F.col("window")).withColumn("window", F.col("to"))
    own = ~F.col("again")
    windows = dealt.groupBy("conv", "null_conv", "window").agg(
        F.first("conv_id").alias("conv_id"), F.min(F.when(own, F.col("before"))).alias("begins"), F.min(F.when(own, F.col("ord"))).alias("first_turn"), F.max(F.when(own, F.col("system"))).alias("system"),
        F.least(F.lit(history), F.greatest(F.lit(0), budget - F.max("system_tokens") - F.sum(F.when(own, F.col("tokens"))))).alias("back"),
        F.sort_array(F.collect_list(F.struct("ord", "again", "before", "turn", "role", "text"))).alias("held"),
    ).where("begins IS NOT NULL")
    kept = F.filter("held", lambda x: ~x["again"] | (x["before"] >= F.col("begins") - F.col("back")))
    windows = windows.withColumn("kept", F.transform(kept, lambda x: F.struct(x["turn"].alias("turn"), x["again"].alias("again"), x["role"].alias("role"), x["text"].alias("text"))))
    place = lambda x: F.struct(x["turn"], x["role"], x["text"])
    ahead = F.struct(F.col("system.turn").alias("turn"), F.lit(True).alias("again"), F.col("system.role").alias("role"), F.col("system.text").alias("text"))
    earlier = F.col("system").isNotNull() & (place(F.col("system")) < place(F.col("kept")[0]))
    windows = windows.withColumn("kept", F.when(earlier, F.concat(F.array(ahead), "kept")).otherwise(F.col("kept")))
    written = F.transform("kept", lambda x: F.struct(F.concat(F.lit("### "), escape_role(x["role"]), F.lit(": ")).alias("head"), escape(x["text"]).alias("body"), (~x["again"] & (x["role"] == "assistant")).alias("loss")))
    windows = windows.withColumn("written", written)
    spans = F.expr(f"""
        aggregate(written, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>)),
          (s, x) -> named_struct('at', s.at + length(x.head) + length(x.body) + {len(END)}L,
            'spans', if(x.loss, array_append(s.spans, named_struct('start', s.at + length(x.head), 'length', cast(length(x.body) as bigint))), s.spans)),
          s -> s.spans)""")
    formatted = F.array_join(F.transform("written", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    repeated = F.size(F.filter("kept", lambda x: x["again"])).cast("bigint")
    return windows.select("conv_id", "window", "first_turn", F.size("kept").cast("bigint").alias("n_turns"), repeated.alias("n_repeated"), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_windows(windows: DataFrame) -> DataFrame:
    """The windows with turns (role, text; repeated ones left out) and targets (texts under the loss mask), read from formatted."""
    parts = F.split("formatted", END, -1)
    own = F.slice(parts, (F.col("n_repeated") + 1).cast("int"), (F.size(parts) - 1 - F.col("n_repeated")).cast("int"))
    body = F.transform(own, lambda x: F.substr(x, F.lit(5)))
    role = lambda x: F.substring_index(x, ": ", 1)
    turns = F.transform(body, lambda x: F.struct(unescape_role(role(x)).alias("role"), unescape(F.substr(x, F.length(role(x)) + 3)).alias("text")))
    targets = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.withColumn("turns", turns).withColumn("targets", targets)


def digest(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read back: for checks."""
    read = read_windows(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = F.struct("first_turn", said.alias("said"), F.array_join("targets", "").alias("target"))
    whole = read.groupBy("conv_id").agg(F.sum(F.col("n_turns") - F.col("n_repeated")).alias("n_turns"), F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.sort_array(F.collect_list(part)).alias("parts"))
    target = F.array_join(F.col("parts.target"), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("parts.said"), ""), 256).alias("turns_sha256"), F.length(target).cast("bigint").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars", "n_windows")

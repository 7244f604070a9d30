"""Chat formatting in budgeted, turn-aligned windows with a loss mask; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plainlake.llm.shared import Workspace

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
BLOCK = 64  # turns in a block of the prefix sums
MARKS = 4  # tokens of a turn's marks and role
PACKED = 16  # windows' tokens in a stretch that is packed at once


def escape(c: Column) -> Column:
    """`<`, any number of `!`, `|` gets one `!` more: no `<|` is left, so no control string is."""
    return F.regexp_replace(c, r"<(!*)\|", "<$1!|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(!*)!\|", "<$1|")


def _role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(LINE))


def _unrole(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(LINE), F.lit("\n")))


def token_estimate(c: Column) -> Column:
    """A quarter of the bytes, and those for the marks of a turn."""
    return (F.ceil(F.octet_length(c) / 4) + MARKS).cast("long")


def numbered(turns: DataFrame, tokens: str | None = None) -> DataFrame:
    """(conv_id, i, role, text, tokens, ahead): the turns of a conversation numbered from 0 in the order of turn (null
    first), role, text, and the tokens of all turns before each. Prefix sums go by blocks of BLOCK turn numbers and then
    over the blocks, so that a conversation that holds a third of all rows is spread over tasks."""
    text = F.coalesce("text", F.lit(""))
    count = token_estimate(text) if tokens is None else (F.coalesce(F.col(tokens), F.lit(0)) + MARKS).cast("long")
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), count.alias("tokens"))
    t = t.withColumn("block", F.floor(F.col("turn") / BLOCK))
    within = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    blocks = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum0"))
    t = t.withColumns({"at": F.row_number().over(within) - 1, "sum": F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")})
    t = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b")))
    return t.select("conv_id", (F.col("n0") + F.col("at")).alias("i"), "role", "text", "tokens", (F.col("sum0") + F.col("sum")).alias("ahead"))


def _starts(room: Column, turns: Column) -> Column:
    """The numbers of the turns with which a window begins: one ends where the next turn would pass the room."""

    def step(s: Column, x: Column) -> Column:
        over = (F.size(s["starts"]) == 0) | (s["used"] + x["tokens"] > room)
        return F.struct(F.when(over, F.concat(s["starts"], F.array(x["i"]))).otherwise(s["starts"]).alias("starts"), (x["tokens"] + F.when(over, F.lit(0).cast("long")).otherwise(s["used"])).alias("used"))

    return F.aggregate(turns, F.struct(F.expr("cast(array() as array<bigint>)").alias("starts"), F.lit(0).cast("long").alias("used")), step)["starts"]


def format_windows(turns: DataFrame, ws: Workspace, budget: int = 1024, history: int = 2, history_tokens: int = 192, tokens: str | None = None) -> DataFrame:
    """One row per window of `turns` (conv_id, turn, role, text): conv_id, window (place of its first new turn), n_repeated
    (turns in front that are not new), n_turns (new ones), formatted, loss (array of start and end, code points of
    `formatted`, of the new assistant texts), n_tokens and over_budget.

    Turns stand in the order of turn (null first), role, text; repeated rows are turns of their own. Null role or text is
    empty; a null conv_id is a conversation. Other columns are not read but `tokens`, which may name a column with the
    tokens of each text (null: none); without it they are estimated as a quarter of the bytes, so a budget may be passed
    by text with more tokens a byte. MARKS tokens a turn come on top. An empty table gives an empty table; a text may be
    of any length.

    A prefix sum says in which stretch of PACKED windows' tokens a turn begins; within a stretch, whose turns are few as
    each has MARKS tokens at least, a window takes turns as long as their sum fits into what the budget leaves beside the
    system turn and the history. So every turn is new in exactly one window, and a window passes the budget only if one
    turn does (over_budget). A window repeats the system turn (a first turn with that role) and at most `history` turns of
    at most `history_tokens` before its first new one, all without loss. Texts are joined once, to the plan of the windows.
    """
    t = ws.save(numbered(turns, tokens), "numbered")
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    system = ws.save(t.filter((F.col("i") == 0) & (F.col("role") == "system")).select(F.col("conv_id").alias("_c"), F.col("tokens").alias("s_tokens")), "system")
    plan = t.select("conv_id", "i", "tokens", "ahead").join(system, same, "left").drop("_c")
    room = F.greatest(F.lit(budget - history_tokens) - F.coalesce("s_tokens", F.lit(0)), F.lit(max(16, budget // 4))).cast("long")
    plan = plan.withColumn("room", room).withColumn("stretch", F.floor(F.col("ahead") / (F.col("room") * PACKED)))
    plan = plan.groupBy("conv_id", "stretch").agg(F.max("room").alias("room"), F.max("s_tokens").alias("s_tokens"), F.sort_array(F.collect_list(F.struct("i", "tokens"))).alias("ts"))
    plan = plan.select("conv_id", "s_tokens", F.col("ts"), _starts(F.col("room"), F.col("ts")).alias("starts"))
    plan = ws.save(plan, "plan")

    x = F.col("x")
    new = plan.select("conv_id", "starts", F.explode("ts").alias("x")).select("conv_id", F.array_max(F.filter("starts", lambda s: s <= x["i"])).alias("window"), x["i"].alias("i"), F.lit(True).alias("new"))
    opened = plan.select("conv_id", "s_tokens", F.explode("starts").alias("window")).filter("window > 0")
    back = opened.select(F.col("conv_id").alias("_c"), "window", "s_tokens", F.explode(F.sequence(F.lit(1), F.lit(max(history, 1)))).alias("back")).filter((F.col("back") <= history) & (F.col("window") >= F.col("back")))
    past = t.select("conv_id", "i", "tokens").join(back, same & (F.col("i") == F.col("window") - F.col("back"))).filter(F.col("s_tokens").isNull() | (F.col("i") > 0))
    far = F.sum("tokens").over(Window.partitionBy("conv_id", "window").orderBy("back"))
    past = past.withColumn("far", far).filter(F.col("far") <= history_tokens).select("conv_id", "window", "i", F.lit(False).alias("new"))
    first = opened.filter("s_tokens is not null").select("conv_id", "window", F.lit(0).cast("long").alias("i"), F.lit(False).alias("new"))
    rows = new.unionByName(past).unionByName(first).select(F.col("conv_id").alias("_c"), F.col("i").alias("_i"), "window", "new")
    every = t.join(rows, same & (F.col("i") == F.col("_i"))).select("conv_id", "window", "tokens", F.struct("i", "new", _role(F.col("role")).alias("role"), escape(F.col("text")).alias("text")).alias("t"))
    w = every.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.sum("tokens").alias("n_tokens"))
    head = lambda x: F.length(x["role"]) + len(START) + 1
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("loss"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + head(x)
        b = a + F.length(x["text"])
        one = F.when(x["new"] & (x["role"] == "assistant"), F.array(F.struct(a.alias("start"), b.alias("end")))).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))
        return F.struct((b + len(END) + 1).alias("at"), F.concat(s["loss"], one).alias("loss"))

    formatted = F.array_join(F.transform("ts", lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END + "\n"))), "")
    return w.select(
        "conv_id", "window", F.size(F.filter("ts", lambda x: ~x["new"])).alias("n_repeated"), F.size(F.filter("ts", lambda x: x["new"])).alias("n_turns"),
        formatted.alias("formatted"), F.aggregate("ts", zero, step)["loss"].alias("loss"), "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What the formatted text and the mask say: conv_id, window, n_turns, turns (role, line feed, text, line feed for
    each new turn), loss_text (what is under the mask, unescaped) and formatted_chars."""
    parts = F.expr(rf"slice(split(formatted, '<\\|im_start\\|>'), n_repeated + 2, n_turns)")
    cut = lambda p: F.instr(p, "\n")
    text = lambda p: F.substr(p, cut(p) + 1, F.length(p) - cut(p) - len(END) - 1)
    role = lambda p: F.substr(p, F.lit(1), cut(p) - 1)
    turns = F.array_join(F.transform(parts, lambda p: F.concat(_unrole(role(p)), F.lit("\n"), unescape(text(p)), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return windows.select("conv_id", "window", F.size(parts).alias("n_turns"), turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A digest of a whole conversation needs its
    text in one row; the windows themselves don't."""
    w = read.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("w"), F.sum("formatted_chars").alias("formatted_chars"))
    joined = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return w.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), sha(joined("turns")).alias("turns_sha256"), F.length(joined("loss_text")).cast("long").alias("loss_chars"), sha(joined("loss_text")).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))

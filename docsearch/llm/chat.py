"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts and roles a backslash becomes ``\\e`` and ``<|`` becomes ``<\\p``
(in roles a newline becomes ``\\l``), so no control string can occur there, and the way back is exact.

Windows are chosen on the prefix sums of turn costs: a window starts at a turn and takes turns while their sum, with the system
turn and the history that it repeats, stays in the budget; a turn alone over the budget is a window of its own, whole.  Every
window after the first begins with the conversation's leading system turn and as many of the turns just before it as
``HISTORY`` allows; these are masked, so each assistant text is under the loss mask exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: In tokens, of which a turn has one for each four UTF-8 bytes and four more.
BUDGET, HISTORY = 1024, 256


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\e")), F.lit("<|"), F.lit("<\\p"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\p"), F.lit("|")), F.lit("\\e"), F.lit("\\"))


def _escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("\\l"))


def _unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("\\l"), F.lit("\n")))


def turns(conversations: DataFrame, history: int = HISTORY) -> DataFrame:
    """(conv_id, turns array<struct<i, role, head, body, before, upto, back>>) in order of turn, then role and text.

    ``before`` and ``upto`` are the prefix sums of costs, ``back`` is the first turn of the history before this one.  Null roles
    and texts are empty.  A conversation is one value, as its digest is; it is the only thing gathered.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"))
    rows = rows.withColumn("cost", F.floor(F.octet_length("body") / 4) + 5)
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("upto", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("cost"))
    # costs are positive, so the sums order the turns, and a range of sums is a stretch of turns
    rows = rows.withColumn("back", F.min("i").over(Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, 0)))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", head, "body", "before", "upto", "back"))).alias("turns"))


def formatted(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, n_repeated, loss array<struct<start, length>>), a row for each window.

    ``start`` (from 1) and ``length`` count code points of the text; ``n_repeated`` turns at its head are repeats.
    conversations: (conv_id, turn, role, text); other columns are ignored, a null conv_id is a conversation too, repeated
    rows are repeated turns, an empty table gives an empty result.
    """
    c = turns(conversations, history)
    has_system = F.element_at("turns", 1)["role"] == "system"
    c = c.withColumn("system", F.when(has_system, F.element_at("turns", 1)["upto"]).otherwise(F.lit(0).cast("long")))
    # a fold over the turns: the sum before the window's first turn, what the window repeats, and the starts so far
    state = F.struct(F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("extra"), F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("back"))).alias("starts"))

    def step(s, t):
        over = (t["before"] > s["base"]) & (t["upto"] - s["base"] + s["extra"] > budget)
        # the system turn comes by itself, never as history
        back = F.when(F.col("system") > 0, F.greatest(t["back"], F.lit(1))).otherwise(t["back"])
        # a history that leaves no room for the turn is left out
        back = F.when(F.col("system") + t["upto"] - F.get("turns", back)["before"] > budget, t["i"]).otherwise(back)
        extra = F.col("system") + t["before"] - F.get("turns", back)["before"]
        return F.when(over, F.struct(t["before"].alias("base"), extra.alias("extra"), F.concat(s["starts"], F.array(F.struct(t["i"].alias("start"), back.alias("back")))).alias("starts"))).otherwise(s)

    c = c.withColumn("starts", F.aggregate("turns", state, step, lambda s: s["starts"]))
    # outer: starts is never empty, and the filter that Spark would infer evaluates the fold once more
    w = c.select("conv_id", "turns", "system", "starts", F.posexplode_outer("starts").alias("window", "s")).withColumn("start", F.col("s.start"))
    stop = F.coalesce(F.get("starts", F.col("window") + 1)["start"], F.size("turns"))
    head = F.when((F.col("window") > 0) & (F.col("system") > 0), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
    begin = F.when(F.col("window") > 0, F.col("s.back")).otherwise(F.col("start"))
    w = w.select("conv_id", "window", F.concat(head, F.slice("turns", begin + 1, stop - begin)).alias("turns"), (F.size(head) + F.col("start") - begin).alias("n_repeated"))
    tail = F.lit(END + "\n")
    place = F.struct(F.lit(1).cast("long").alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def mark(s, t):
        start, n = s["at"] + F.length(t["head"]), F.length(t["body"]).cast("long")
        own = (s["i"] >= F.col("n_repeated")) & (t["role"] == "assistant")
        span = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n + len(END) + 1).alias("at"), (s["i"] + 1).alias("i"), F.when(own, F.concat(s["loss"], span)).otherwise(s["loss"]).alias("loss"))

    return w.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "").alias("text"),
        "n_repeated",
        F.aggregate("turns", place, mark, lambda s: s["loss"]).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss array<string>, chars) of the formatted windows, in their order."""
    raw = F.transform(F.filter(F.split("text", r"<\|im_end\|>\n"), lambda x: x != ""), lambda x: F.substring(x, len(START) + 1, F.length(x)))
    cut = lambda x: F.instr(x, "\n")
    parsed = F.transform(raw, lambda x: F.struct(_unescape_role(F.substring(x, F.lit(1), cut(x) - 1)).alias("role"), unescape(F.substring(x, cut(x) + 1, F.length(x))).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"].cast("int"), s["length"].cast("int"))))
    w = windows.select("conv_id", F.struct("window", F.slice(parsed, F.col("n_repeated") + 1, F.size(parsed)).alias("turns"), loss.alias("loss"), F.length("text").cast("long").alias("chars")).alias("w"))
    g = w.groupBy("conv_id").agg(F.array_sort(F.collect_list("w"), lambda a, b: a["window"] - b["window"]).alias("w"))
    return g.select("conv_id", F.flatten("w.turns").alias("turns"), F.flatten("w.loss").alias("loss"), F.aggregate("w.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"))


def example(spark: SparkSession) -> DataFrame:
    """Conversation -1: control strings in what is said."""
    said = END + START + "assistant ok"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the windows."""
    back = read_back(formatted(conversations))
    joined = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(joined).cast("long").alias("loss_chars"),
        F.sha2(joined, 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )

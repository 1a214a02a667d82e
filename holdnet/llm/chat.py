"""Chat formatting in budgeted, turn-aligned windows; DataFrame functions only.

Prefix sums of the turns' tokens (an estimate: a token per four bytes of the text before escaping, plus the marks) cut
a conversation into spans of whole turns.  Every window holds the leading
system turn, then earlier turns repeated as history (at most ``history``
tokens), then its own span.  Only assistant texts of the own span are under the
loss mask, so each is learned once however often it is repeated.

A turn belongs to the span floor(tokens before it / stride).  The stride of a conversation leaves room for the system turn,
the history and the longest turn, so every window keeps to ``budget`` as long as each turn does beside the system
turn; where the stride would be shorter than the history, the conversation goes without history.  Windows that a longer turn
takes beyond the budget say so (``over_budget``); no turn is cut.

Template: ``<s>[INST]role\\ntext[/INST]`` for all roles but ``assistant``, which
is ``<s>role\\ntext</s>``.  Control strings inside roles and texts get a backslash
after their first character, backslashes are doubled, so reading back is exact.

Prefix sums are taken in two levels (runs of ``BUCKET`` turn numbers, then the
turns inside a run), so that one very long conversation spreads over many tasks.

Defined results: null texts and roles are empty; a null conv_id is a
conversation of its own; a null turn comes first; rows that share a turn number
are ordered by role and text, exact repeats stay; empty tables give no windows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdnet.llm.common import written

BUDGET = 512
HISTORY = 128
MARK_TOKENS = 8
BUCKET = 256

#: Fixed values of the template.
START, INST, INST_END, END, LINE = "<s>", "[INST]", "[/INST]", "</s>", "[NL]"
CONTROLS = (START, INST, INST_END, END, LINE)
TARGET = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in CONTROLS:
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def turn_tokens(text: Column) -> Column:
    return (F.ceil(F.octet_length(text) / 4) + MARK_TOKENS).cast("long")


def _before(window) -> object:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def placed(turns: DataFrame, conv: str, turn: str, role: str, text: str, budget: int, history: int) -> DataFrame:
    """Turns with their position, tokens, tokens before them, the conversation's history and their span
    (``conv, pos, lead, role, text, tok, back, before, span``)."""
    t = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("tok", turn_tokens(F.col("text"))).withColumn("run", F.floor(F.col("turn") / BUCKET))
    runs = t.groupBy("conv", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("tokens"), F.max("tok").alias("longest"),
                                        F.min(F.struct("turn", "role", F.octet_length("text").alias("size"), "tok")).alias("head"))
    by_run = Window.partitionBy("conv").orderBy("run")
    whole = by_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select(
        F.col("conv").alias("c"), F.col("run").alias("r"),
        F.coalesce(F.sum("n").over(_before(by_run)), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("tokens").over(_before(by_run)), F.lit(0)).alias("tokens_before"),
        F.first("head").over(whole).alias("head"), F.max("longest").over(whole).alias("longest"))
    in_run = Window.partitionBy("conv", "run").orderBy("turn", "role", F.octet_length("text"), "text")
    t = t.join(runs, F.col("conv").eqNullSafe(F.col("c")) & F.col("run").eqNullSafe(F.col("r")))
    system = F.when(F.col("head.role") == "system", F.col("head.tok")).otherwise(F.lit(0))
    room = F.lit(budget + 1) - system - F.col("longest")
    back = F.when(room - history >= history, F.lit(history)).otherwise(F.lit(0))
    t = t.select(
        "conv", "role", "text", "tok", back.alias("back"), (F.col("rows_before") + F.row_number().over(in_run)).alias("pos"),
        (F.col("tokens_before") + F.coalesce(F.sum("tok").over(_before(in_run)), F.lit(0))).alias("before"),
        F.greatest(room - back, F.lit(1)).alias("stride"))
    return t.select("conv", "pos", ((F.col("pos") == 1) & (F.col("role") == "system")).alias("lead"), "role", "text", "tok", "back",
                    "before", F.floor(F.col("before") / F.col("stride")).alias("span"))


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: ``conv_id, window, formatted, n_repeated, tokens, over_budget, loss`` (array of start, end in code points)."""
    if not 0 < history <= budget - history:
        raise ValueError("history must be at most half of the budget")
    t = written(placed(turns, conv, turn, role, text, budget, history), "turns")  # read three times below
    spans = t.groupBy("conv", "span").agg(F.min("before").alias("at"))
    following = spans.select(F.col("conv").alias("c"), (F.col("span") - 1).alias("s"), F.col("at").alias("next_at"))
    t = t.join(following, F.col("conv").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s")), "left").drop("c", "s")
    # the stride is at least the history: a turn can be history of the next span only
    again = ~F.col("lead") & (F.col("next_at") - F.col("before") <= F.col("back"))
    uses = F.array_compact(F.array(
        F.struct(F.col("span").alias("window"), F.lit(False).alias("repeated")),
        F.when(again, F.struct((F.col("span") + 1).alias("window"), F.lit(True).alias("repeated")))))
    shown = t.select("conv", "pos", "role", "text", "tok", F.explode(uses).alias("u")).select(
        "conv", F.col("u.window").alias("window"), "pos", F.col("u.repeated").alias("repeated"), "role", "text", "tok")
    lead = t.filter("lead").select(F.col("conv").alias("c"), "pos", "role", "text", "tok")
    kept = spans.filter("span > 0").join(lead, F.col("conv").eqNullSafe(F.col("c"))).select(
        "conv", F.col("span").alias("window"), "pos", F.lit(True).alias("repeated"), "role", "text", "tok")
    listed = shown.unionByName(kept).groupBy("conv", "window").agg(
        F.sort_array(F.collect_list(F.struct("pos", "repeated", "role", "text"))).alias("turns"), F.sum("tok").alias("tokens"))

    def opening(x: Column) -> Column:
        return F.concat(F.lit(START), F.when(x["role"] == TARGET, F.lit("")).otherwise(F.lit(INST)),
                        escape_role(x["role"]), F.lit("\n"))

    marked = listed.select("conv", "window", "tokens", F.transform("turns", lambda x: F.struct(
        opening(x).alias("open"), escape(x["text"]).alias("body"),
        F.when(x["role"] == TARGET, F.lit(END)).otherwise(F.lit(INST_END)).alias("close"),
        ((x["role"] == TARGET) & ~x["repeated"]).alias("target"), x["repeated"].alias("repeated"))).alias("turns"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["open"])
        stop = start + F.length(x["body"])
        mask = F.when(x["target"], F.array(F.struct(start.alias("start"), stop.alias("end")))).otherwise(
            F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((stop + F.length(x["close"])).alias("at"), F.concat(acc["loss"], mask).alias("loss"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return marked.select(
        F.col("conv").alias("conv_id"), "window",
        F.array_join(F.transform("turns", lambda x: F.concat(x["open"], x["body"], x["close"])), "").alias("formatted"),
        F.size(F.filter("turns", lambda x: x["repeated"])).alias("n_repeated"),
        "tokens", (F.col("tokens") > budget).alias("over_budget"),
        F.aggregate("turns", zero, step, lambda a: a["loss"]).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, window, n_repeated, over_budget, turns, loss_text, chars`` parsed from the windows: turns new in the window as
    (role, text)."""
    parts = F.slice(F.split("formatted", START), F.col("n_repeated") + 2, F.length("formatted"))

    def parse(p: Column) -> Column:
        inst = F.startswith(p, F.lit(INST))
        body = F.when(inst, F.substring(p, F.lit(len(INST) + 1), F.length(p) - len(INST) - len(INST_END))).otherwise(
            F.substring(p, F.lit(1), F.length(p) - len(END)))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"),
                        unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    loss = F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "window", "n_repeated", "over_budget", F.transform(parts, parse).alias("turns"),
                            F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("chars"))


def digests(parsed: DataFrame) -> DataFrame:
    """One row per conversation: counts and digests of what was read back."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    per = parsed.select("conv_id", F.struct("window", said.alias("said"), "loss_text").alias("w"),
                        F.size("turns").alias("n"), F.length("loss_text").alias("loss_chars"), "chars", "n_repeated", "over_budget")
    per = per.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("loss_chars").cast("long").alias("loss_chars"),
        F.sum("chars").cast("long").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("ws"),
        F.count(F.lit(1)).alias("n_windows"), F.sum("n_repeated").cast("long").alias("n_repeated"),
        F.max("over_budget").alias("over_budget"))
    whole = lambda name: F.sha2(F.array_join(F.transform("ws", lambda w: w[name]), ""), 256)
    return per.select("conv_id", "n_turns", whole("said").alias("turns_sha256"), "loss_chars",
                      whole("loss_text").alias("loss_sha256"), "formatted_chars", "n_windows", "n_repeated", "over_budget")

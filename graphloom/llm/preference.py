"""Preference formatting: the longest common turn prefix of two conversations is rendered once as the prompt,
and the rest of each becomes a completion with the spans to train on. DataFrame functions only.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|start|>", "\n", "<|end|>\n"
TRAINED_ROLES = ("assistant",)
TURN = "struct<role:string,text:string>"
REFUSAL = "I have no answer to that."


def turns_of(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns): the turns of every conversation in order, each as (role, text).

    Ordered by turn, then role and text, so repeated rows stay and ties have one order. Null roles and texts
    are empty. Rows without a turn number come first. A row without an id belongs to no other: it is a conversation of its own,
    so that such rows never come together in one task.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in ("role", "text"))
    row = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), role.alias("role"), text.alias("text"))
    ordered = F.sort_array(F.collect_list(row))
    key = F.col(f"`{id_col}`")
    alone = F.when(key.isNull(), F.monotonically_increasing_id()).alias("_alone")
    turns = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    return df.groupBy(key, alone).agg(turns).drop("_alone")


def common_prefix(a, b):
    """Number of leading turns that two turn arrays share."""
    shorter = F.least(F.size(a), F.size(b))
    at = F.sequence(F.lit(0), shorter)  # the place after the shorter one always differs
    return F.get(F.filter(at, lambda i: (i == shorter) | (F.get(a, i) != F.get(b, i))), F.lit(0))


def render(turns):
    """Turns as text: start mark, role, line end, text, end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def spans(turns, roles=TRAINED_ROLES):
    """(start, length) in code points, within ``render(turns)``, of what is trained on: text and end mark of the
    given roles. All else is masked."""
    head = lambda t: F.lit(len(START) + len(MIDDLE)) + F.length(t["role"])
    body = lambda t: F.length(t["text"]) + F.lit(len(END))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state, t):
        here = F.array(F.struct((state["at"] + head(t)).alias("start"), body(t).alias("length")))
        kept = F.when(t["role"].isin(*roles), F.concat(state["spans"], here)).otherwise(state["spans"])
        return F.struct((state["at"] + head(t) + body(t)).alias("at"), kept.alias("spans"))

    return F.aggregate(turns, empty, add, lambda s: s["spans"])


def format_pairs(df: DataFrame, id_col: str, chosen: str = "chosen_turns", rejected: str = "rejected_turns", roles=TRAINED_ROLES) -> DataFrame:
    """One row per pair of turn arrays: id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    A null side counts as no turns. Where one side is a prefix of the other its completion is empty; equal
    sides give two empty completions. Repeated pairs are formatted each.
    """
    side = lambda c: F.coalesce(F.col(c), F.array().cast(f"array<{TURN}>"))
    n = F.col("_n")
    rest = lambda c: F.slice(F.col(c), n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    return (
        df.select(F.col(f"`{id_col}`"), side(chosen).alias("_c"), side(rejected).alias("_r")).withColumn("_n", common_prefix(F.col("_c"), F.col("_r")))
        .select(
            id_col, n.alias("n_prompt_turns"), render(F.slice("_c", F.lit(1), n)).alias("prompt"),
            render(rest("_c")).alias("chosen"), render(rest("_r")).alias("rejected"),
            spans(rest("_c"), roles).alias("chosen_spans"), spans(rest("_r"), roles).alias("rejected_spans"))
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, id_col: str = "pair_id", roles=TRAINED_ROLES) -> DataFrame:
    """As ``format_pairs``, from two tables of turns (id, turn, role, text); a pair lacking a side has it empty, and so has a row
    without an id, which is no pair with any other."""
    c = turns_of(chosen, id_col).withColumnRenamed("turns", "chosen_turns")
    r = turns_of(rejected, id_col).withColumnRenamed("turns", "rejected_turns").withColumnRenamed(id_col, "_rid")
    both = c.join(r, F.col(id_col) == F.col("_rid"), "full")
    return format_pairs(both.withColumn(id_col, F.coalesce(id_col, "_rid")), id_col, roles=roles)


def stale_answers(df: DataFrame, id_col: str = "conv_id", fallback: str = REFUSAL) -> DataFrame:
    """A preference pair from every conversation: (id, chosen_turns, rejected_turns).

    Chosen is the conversation up to its last assistant turn. Rejected repeats there the assistant's answer
    before, or ``fallback`` if there was none. Without an assistant turn both are the whole conversation.
    """
    t = F.col("turns")
    answers = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i)["role"] == "assistant")
    at, earlier = F.get("_a", F.size("_a") - 1), F.get("_a", F.size("_a") - 2)
    old = F.coalesce(F.get(t, earlier)["text"], F.lit(fallback))
    swapped = F.concat(F.slice(t, F.lit(1), at), F.array(F.struct(F.lit("assistant").alias("role"), old.alias("text"))))
    some = F.size("_a") > 0
    return turns_of(df, id_col).withColumn("_a", answers).select(
        id_col, F.when(some, F.slice(t, F.lit(1), at + 1)).otherwise(t).alias("chosen_turns"), F.when(some, swapped).otherwise(t).alias("rejected_turns"))


def spans_text(column):
    """Spans as text, ``start+length`` joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string"))), ",")

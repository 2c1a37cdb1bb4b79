"""Conversations as training texts of a limited number of tokens.

Prefix sums of the turns' tokens place every turn: the line of tokens is cut into steps, the
turns that lie in one step form a window, a turn that crosses into another step is a window
of its own. A window repeats the leading system turn and, up to a limit of tokens, the turns
before its first one. Every turn is new in exactly one window; only there its text, if it is
the assistant's, lies under the loss mask. Tokens are counted as words and signs.

Prefix sums are taken within blocks of turn numbers and then over the blocks, and history is
found by an equal join on steps, so a conversation of any length is spread over tasks. Only
the read-back digests of :func:`conversation_digests` need a conversation as one value.

Template: ``### role``, a line break, the text, a line break, ``</turn>``, a line break. The
control strings ``### `` and ``</turn>`` inside a text get a backslash in front, as do those
that already have some; reading takes one away. Roles are written percent-encoded.

Defined cases: null roles and texts are empty; a null conversation is one like any other;
turns of equal number are ordered by role and text, a null number comes last; repeated rows
are turns of their own. A turn or system turn that exceeds the budget is kept whole, in a
window that then exceeds it as well. An empty table gives no windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
BLOCK = 256
TURN_TOKENS = 4
END = "\n</turn>\n"
CONTROL = r"(\\*(?:</turn>|### ))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def _same(left: str, right: str, names: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}")) for name in names])


def _placed_turns(conversations: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Turns with their number ``n``, ``tokens`` and the tokens before them, ``start``."""
    turns = conversations.select(
        F.col(columns["conv_id"]).alias("conv_id"),
        F.col(columns["turn"]).alias("turn"),
        F.coalesce(F.col(columns["role"]).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(columns["text"]).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", F.regexp_count("text", F.lit(r"\w+|[^\w\s]")).cast("bigint") + TURN_TOKENS)
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    turns = turns.withColumn("n", F.row_number().over(inside).cast("bigint")).withColumn(
        "start", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    )
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("rows"), F.sum("tokens").alias("size"))
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id",
        "block",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before"),
    )
    return (
        turns.alias("t")
        .join(blocks.alias("b"), _same("t", "b", ["conv_id", "block"]))
        .select(
            "t.conv_id",
            (F.col("t.n") + F.col("b.rows_before")).alias("n"),
            "t.role",
            "t.text",
            "t.tokens",
            (F.col("t.start") + F.col("b.size_before")).alias("start"),
        )
    )


def format_windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per window.

    ``conv_id``, ``first_turn`` (number of its first new turn, from 1), ``text``,
    ``n_repeated`` (turns at its start that other windows have as new), ``n_tokens`` and
    ``loss``, the masked spans: start (from 0) and length, in code points of ``text``.
    """
    placed = _placed_turns(conversations, {"conv_id": conv_id, "turn": turn, "role": role, "text": text})
    header = F.concat(F.lit("### "), F.url_encode("role"), F.lit("\n"))
    turns = placed.select(
        "conv_id",
        "n",
        "tokens",
        "start",
        ((F.col("n") == 1) & (F.col("role") == "system")).alias("is_system"),
        (F.col("role") == "assistant").alias("is_target"),
        F.length(header).alias("header_chars"),
        F.concat(header, escaped(F.col("text")), F.lit(END)).alias("body"),
    )
    systems = turns.filter("is_system")
    sized = (
        turns.alias("t")
        .join(systems.alias("s"), F.col("t.conv_id").eqNullSafe(F.col("s.conv_id")), "left")
        .select("t.*", F.greatest(F.lit(budget - history) - F.coalesce("s.tokens", F.lit(0)), F.lit(1)).cast("bigint").alias("step"))
    )
    step_of = lambda place: F.floor(place / F.col("step"))
    new = sized.withColumn("first_step", step_of(F.col("start"))).withColumn(
        "last_step", step_of(F.col("start") + F.col("tokens") - 1)
    )
    key = ["conv_id", "first_step", "last_step"]
    windows = new.groupBy(*key).agg(F.min("start").alias("opens"), F.min("n").alias("first_turn"))
    part = ["n", "tokens", "is_target", "header_chars", "body"]
    near = (
        sized.filter("not is_system")
        .withColumn(
            "first_step",
            F.explode(F.sequence(step_of(F.col("start") + 1), step_of(F.col("start") + history))),
        )
        .alias("t")
        .join(windows.alias("w"), _same("t", "w", ["conv_id", "first_step"]))
        .filter("w.opens > t.start and w.opens <= t.start + " + str(int(history)))
        .select(*[f"w.{name}" for name in key], *[f"t.{name}" for name in part], F.lit(True).alias("repeated"))
    )
    lead = (
        windows.filter("first_turn > 1")
        .alias("w")
        .join(systems.alias("s"), F.col("w.conv_id").eqNullSafe(F.col("s.conv_id")))
        .select(*[f"w.{name}" for name in key], *[f"s.{name}" for name in part], F.lit(True).alias("repeated"))
    )
    members = new.select(*key, *part, F.lit(False).alias("repeated")).unionByName(near).unionByName(lead)
    # A window holds no more turns than its budget of tokens, or one turn.
    gathered = members.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("n", "repeated", "is_target", "header_chars", F.length("body").alias("chars"), "tokens", "body"))).alias("turns")
    )
    span = "struct<at:bigint,spans:array<struct<start:bigint,length:bigint>>>"
    nothing = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(span)

    def masked(done: Column, item: Column) -> Column:
        own = F.struct(
            (done["at"] + item["header_chars"]).alias("start"),
            (item["chars"] - item["header_chars"] - len(END)).cast("bigint").alias("length"),
        )
        spans = F.when(item["is_target"] & ~item["repeated"], F.concat(done["spans"], F.array(own))).otherwise(done["spans"])
        return F.struct((done["at"] + item["chars"]).alias("at"), spans.alias("spans")).cast(span)

    return gathered.select(
        "conv_id",
        F.array_min(F.transform(F.filter("turns", lambda t: ~t["repeated"]), lambda t: t["n"])).alias("first_turn"),
        F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("text"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda total, t: total + t["tokens"]).alias("n_tokens"),
        F.aggregate("turns", nothing, masked)["spans"].alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a window's text, read back: role and text."""
    pieces = F.split(text, END)

    def turn_of(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return F.struct(
            F.url_decode(F.substr(role, F.lit(5))).alias("role"),
            unescaped(F.substr(piece, F.length(role) + 2)).alias("text"),
        )

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn_of)


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under the mask, read back."""
    return F.transform(loss, lambda s: unescaped(F.substr(text, s["start"].cast("int") + 1, s["length"].cast("int"))))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: turns and masked texts, read back in order."""
    turns = read_turns(F.col("text"))
    new = F.slice(turns, F.col("n_repeated") + 1, F.size(turns))
    read = windows.select(
        "conv_id",
        "first_turn",
        (F.size(turns) - F.col("n_repeated")).cast("bigint").alias("n_turns"),
        F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join(read_loss(F.col("text"), F.col("loss")), "").alias("masked"),
        F.length("text").cast("bigint").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("first_turn", "turns", "masked"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    masked = F.array_join(F.transform("parts", lambda p: p["masked"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("parts", lambda p: p["turns"]), ""), 256).alias("turns_sha256"),
        F.length(masked).cast("bigint").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        "formatted_chars",
    )

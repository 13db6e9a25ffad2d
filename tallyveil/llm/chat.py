"""Prefix-target expansion of conversations, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

HEAD, SEP, END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    """Hides the template's control strings. Backslashes are doubled first, so that the single ones set after can't be mistaken."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(text, F.lit("### "), F.lit("##\\# "))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("##\\# "), F.lit("### "))
    text = F.replace(text, F.lit("<\\/turn>"), F.lit("</turn>"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, body, chars, turns.

    body is the UTF-8 of every turn as '### <role>: <text></turn>' and a newline, in the order of turn
    (ties by role, then text; null turns first; repeated rows stay), chars its length in characters.
    Control strings in texts and roles are escaped; a colon in a role becomes '\\:'. turns holds for
    each turn its number, whether it is an assistant's, in bytes of body where it starts, where its text
    starts and ends, and where it ends, and in characters where it ends. Null texts and roles count as
    empty; null conv_ids form one conversation. Extra columns are ignored, whatever their names; an
    empty table gives an empty result; texts are never cut, however long.

    A conversation is one training text and so one row, however many turns it has: body is stored
    once, and the examples of `expand` point into it instead of repeating their contexts, whose
    length would grow with the square of the number of turns. Places are in bytes, as a span of bytes
    is cut without walking through the body from its start.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(SEP))
    full = F.concat(head, escape(text), F.lit(END))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("raw"), F.octet_length(head).alias("head"), full.alias("full"))
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")

    def before(size: Column) -> Column:
        return F.coalesce(F.sum(size).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")

    rows = rows.withColumn("position", F.row_number().over(so_far) - 1)
    rows = rows.withColumn("start", before(F.octet_length("full"))).withColumn("chars", before(F.char_length("full")) + F.char_length("full"))
    end = F.col("start") + F.octet_length("full")
    turn = F.struct(
        "position", (F.col("role") == "assistant").alias("assistant"), "start", (F.col("start") + F.col("head")).alias("text_start"),
        (end - len(END)).alias("text_end"), end.alias("end"), "chars", "full",
    )
    rows = rows.select("conv_id", turn.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["full"]), "").cast("binary").alias("body"),
        F.element_at("all", -1)["chars"].alias("chars"),
        F.transform("all", lambda x: x.dropFields("full")).alias("turns"),
    )


def expand(formatted: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, target (turn position), size, chars, loss_start, loss_end.

    Every assistant turn becomes an example: the first `size` bytes (`chars` characters) of body, which
    are all turns before it as context and the reply itself. Only the bytes loss_start to loss_end of
    body, the reply's escaped text, are trainable. Turns after the last reply, or a conversation
    without a reply, form one more example with target null and an empty loss span, so that nothing is
    lost.
    """
    rows = formatted.select("conv_id", "turns")
    last = F.element_at("turns", -1)

    def example(target: Column, turn: Column, first: Column, end: Column) -> Column:
        return F.struct(target.alias("target"), turn["end"].alias("size"), turn["chars"].alias("chars"), first.alias("loss_start"), end.alias("loss_end"))

    tail = F.when(~last["assistant"], F.array(example(F.lit(None).cast("int"), last, last["end"], last["end"])))
    own = F.transform(F.filter("turns", lambda t: t["assistant"]), lambda t: example(t["position"], t, t["text_start"], t["text_end"]))
    examples = F.concat(own, F.coalesce(tail, F.filter(own, lambda x: F.lit(False))))
    return rows.select("conv_id", F.posexplode(examples).alias("example", "x")).select("conv_id", "example", "x.*")


def write(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Formats turns, and writes the conversations and their examples; returns both as they are read again."""
    formatted = materialise(format_conversations(turns), "conversations")
    return formatted, materialise(expand(formatted), "examples")


def _cut(body: Column, first: Column, end: Column) -> Column:
    return F.substring(body, (first + 1).cast("int"), (end - first).cast("int"))


def render(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """The examples with their own text: conv_id, example, text (UTF-8), loss_start, loss_end (bytes of text)."""
    joined = examples.join(formatted.select(F.col("conv_id").alias("_conv"), "body"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.select("conv_id", "example", _cut(F.col("body"), F.lit(0), F.col("size")).alias("text"), "loss_start", "loss_end")


def read_back(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """What the output says: conv_id, turns (role, text), loss (texts under the loss masks, in order), formatted_chars.

    Turns are cut at the template's marks and unescaped. The loss is what lies under the examples'
    masks, unescaped, whatever they say: a mask that is wrong by a byte gives another text.
    formatted_chars is the length of all examples, each with its whole context: characters are counted in the body as it was
    read, turn by turn, and an example has those of the turns up to where it ends. One that ends inside a turn has none.
    """
    mask = F.struct("example", "target", "loss_start", "loss_end")
    masks = examples.groupBy(F.col("conv_id").alias("_conv")).agg(F.array_sort(F.collect_list(mask)).alias("masks"))
    parts = F.split(F.col("body").cast("string"), END)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    so_far = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = formatted.select(F.col("conv_id").alias("of"), F.posexplode(parts).alias("at", "part"))
    ends = ends.select("of", F.sum(F.octet_length("part") + len(END)).over(so_far).alias("bytes"), F.sum(F.char_length("part") + len(END)).over(so_far).alias("length"))
    told = examples.join(ends, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("size") == F.col("bytes")), "left")
    told = told.groupBy(F.col("conv_id").alias("_told")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("formatted_chars"))

    def turn(part: Column) -> Column:
        at = F.regexp_instr(part, F.lit(r"(?<!\\)(?:\\\\)*: "))
        colon = at + F.char_length(F.regexp_extract(part, r"(?<!\\)((?:\\\\)*): ", 1))
        role = F.substr(part, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)
        return F.struct(
            unescape(F.replace(role, F.lit("\\:"), F.lit(":"))).alias("role"),
            unescape(F.substr(part, colon + len(SEP))).alias("text"),
        )

    shown = F.filter("masks", lambda m: m["target"].isNotNull())
    loss = F.transform(shown, lambda m: unescape(_cut(F.col("body"), m["loss_start"], m["loss_end"]).cast("string")))
    joined = formatted.select("conv_id", "body").join(masks, F.col("conv_id").eqNullSafe(F.col("_conv"))).join(told, F.col("conv_id").eqNullSafe(F.col("_told")))
    return joined.select("conv_id", F.transform(parts, turn).alias("turns"), loss.alias("loss"), "formatted_chars")

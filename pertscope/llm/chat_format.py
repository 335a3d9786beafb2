"""Chat formatting by grammar round trip: a conversation is rendered, the
rendered text is parsed again, the recovered turns are compared with the
source, and conflicting content is escaped further until they are identical.
DataFrame functions only.

Grammar of the rendered text::

    conversation = { START role MODE "\n" body "\n" STOP "\n" }
    START = "<|im_start|>"    STOP = "<|im_end|>"    MODE = "" | ";url"

START and STOP count only where no backslash stands before them, and a body
holds neither.  Escaping puts one more backslash before every control string in
a text; the line feed before STOP keeps a final backslash of the text apart from
it.  The parser matches the whole grammar: a text that departs from it anywhere
(an end mark that is missing, early or doubled, text outside the marks) does not
parse and gives null.  Where the parse differs from the source, the texts of that conversation are
URL-encoded (MODE ``;url``), which no control string survives.  Roles are
always URL-encoded.

Defined results: null texts and roles are empty; rows are ordered by turn,
then role, then text, so ties and repeated rows have one order (repeated rows
are turns of their own); a null ``conv_id`` is one conversation; an empty table
gives an empty table; other columns are ignored.  A conversation is one value
of the result, so its turns meet in one row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of this template and of common others.
START, STOP = "<|im_start|>", "<|im_end|>"
CONTROL = (r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>|\[INST\]|\[/INST\]"
           r"|<<SYS>>|<</SYS>>|<s>|</s>")
URL = ";url"
BARE_START, BARE_STOP = r"(?<!\\)<\|im_start\|>", r"(?<!\\)<\|im_end\|>"
HEAD = r"\A[A-Za-z0-9.*_+%-]*(;url)?\z"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def render(turns: Column, encode: bool = False) -> Column:
    """Text of an array of ``struct(role, text)``."""
    body = (lambda t: F.url_encode(t)) if encode else escape
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), F.url_encode(t["role"]), F.lit(URL if encode else ""), F.lit("\n"), body(t["text"]),
        F.lit("\n" + STOP + "\n"))), "")


def parse(text: Column) -> Column:
    """Turns ``struct(role, text)`` of a rendered text; null if it is none."""
    pieces = F.split(text, BARE_START)
    end = "\n" + STOP + "\n"

    def is_turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        return (head.rlike(HEAD) & p.endswith(end) & (F.regexp_count(p, F.lit(BARE_STOP)) == 1)
                & (F.char_length(p) > F.char_length(head) + len(end)))

    whole = (F.get(pieces, F.lit(0)) == "") & F.forall(F.slice(pieces, F.lit(2), F.size(pieces)), is_turn)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        # what stands between the first line feed and the last "\n" + STOP + "\n"
        body = F.substring(p, F.char_length(head) + F.lit(2), F.char_length(p) - F.char_length(head) - 3 - len(STOP))
        coded = head.endswith(URL)
        role = F.url_decode(F.when(coded, F.substring(head, F.lit(1), F.char_length(head) - len(URL)))
                            .otherwise(head))
        return F.struct(role.alias("role"),
                        F.when(coded, F.url_decode(F.when(coded, body).otherwise(F.lit(""))))
                        .otherwise(unescape(body)).alias("text"))

    turns = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)
    return F.when(text == "", F.array().cast("array<struct<role:string,text:string>>")).when(whole, turns)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``turns`` read back from it."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
    conv = conv.select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"),
                                                                     t["text"].alias("text"))).alias("_source"))
    conv = conv.withColumn("_plain", render(F.col("_source")))
    conv = conv.withColumn("_back", parse(F.col("_plain")))
    conv = conv.withColumn("formatted", F.when(F.col("_back").eqNullSafe(F.col("_source")), F.col("_plain"))
                           .otherwise(render(F.col("_source"), encode=True)))
    conv = conv.withColumn("turns", F.when(F.col("formatted") == F.col("_plain"), F.col("_back"))
                           .otherwise(parse(F.col("formatted"))))
    return conv.select("conv_id", "formatted", "turns", (F.col("turns") == F.col("_source")).alias("identical"))


def digest(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """The contract's columns, all taken from the recovered turns; the loss
    mask covers the texts of ``loss_role``."""
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    return formatted.withColumn("_loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
                            "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))

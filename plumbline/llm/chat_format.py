"""Chat formatting from event logs.  DataFrame functions only.

A log has one event per row: conversation, sequence number, turn, operation, role, text.
``message`` sets a turn's text, ``delta`` appends a streamed part, ``edit`` replaces the text so
far, ``regenerate`` starts the turn anew and discards the later turns of the time before.  The
events of a turn are folded into one message, the messages of a conversation are rendered in
order of their turns, and the places of the texts to learn from are kept as a loss mask.

Template: ``<|im_start|>role`` newline text ``<|im_end|>`` newline.  Inside role and text a
backslash is doubled and ``<|`` becomes ``<\\|``, in a role a newline becomes ``\\l``; so the
marks stay unique and ``read_back`` returns every turn as it was.

One conversation is one row of the result, hence one value; nothing larger is gathered.

Edge cases: null texts, roles are empty; a null operation is a message; null conversation ids
form one conversation; repeated events with the same sequence number apply in order of
operation, role and text; an empty log gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import quoted

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escape(text: Column, one_line: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\l")) if one_line else out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: between doubled backslashes, every other escape is what it seems."""
    plain = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(
        F.replace(p, F.lit("<\\|"), F.lit("<|")), F.lit("\\l"), F.lit("\n")))
    return F.array_join(plain, "\\")


def as_log(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows that are whole turns as a log of messages; every row is a turn of its own."""
    rows = turns.select(
        quoted(conv).alias("conv"), quoted(turn).cast("bigint").alias("at"),
        F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("at", "role", "text")
    return rows.select(
        "conv", F.row_number().over(order).cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("seq"),
        F.lit("message").alias("op"), "role", "text")


def fold(log: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of the messages that a log (conv, turn, seq, op, role, text) ends with."""
    op = F.coalesce(F.col("op"), F.lit("message"))
    event = F.struct(
        F.col("seq"), F.when(op == "delta", 1).otherwise(0).alias("rank"), op.alias("op"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = log.groupBy("conv", "turn").agg(F.array_sort(F.collect_list(event)).alias("events"))
    redone = F.array_max(F.transform("events", lambda e: F.when(e["op"] == "regenerate", e["seq"])))
    before = Window.partitionBy("conv").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max(redone).over(before))
    # What came before an earlier turn was regenerated is gone.
    left = F.filter("events", lambda e: F.col("cut").isNull() | e["seq"].isNull() | (e["seq"] >= F.col("cut")))
    turns = turns.select("conv", "turn", left.alias("events")).where(F.size("events") > 0)
    starts = F.transform("events", lambda e, i: F.when(e["op"] != "delta", i))
    turns = turns.withColumn("first", F.coalesce(F.array_max(starts), F.lit(0)))
    return turns.select(
        "conv", "turn", F.col("events")[F.col("first")]["role"].alias("role"),
        F.array_join(F.transform(F.slice("events", F.col("first") + 1, F.size("events")), lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """(conv, formatted, loss_spans): spans are (start, length) in code points, 0-based."""
    head = F.concat(F.lit(START), escape(F.col("role"), True), F.lit("\n"))
    parts = messages.select(
        "conv", "turn", (F.col("role") == learned).alias("learn"), head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END) + 1
    before = Window.partitionBy("conv").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(size.cast("bigint")).over(before), F.lit(0)) + F.length("head"))
    rows = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.concat("head", "body", F.lit(f"{END}\n")).alias("piece"), "start",
        F.length("body").cast("bigint").alias("length"), "learn"))).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return rows.select("conv", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_chats(log: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """A log's conversations, folded and rendered: (conv, formatted, loss_spans)."""
    return render(fold(log), learned)


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    marked = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        at = F.instr(x, "\n")
        body = F.substring(x, at + 1, F.length(x) - at - (len(END) + 1))
        return F.struct(unescape(F.substring(x, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(marked, turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))

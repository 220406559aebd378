"""Chat formatting with Spark expressions only.

Template. A run of adjacent turns of one role is one block

    ### <role>: <text><|next|><text>...</turn>\n

Inside roles and texts a backslash is doubled and each control string gets a
backslash after its first character, so that no control string can occur in
them; dropping each backslash that stands before a character, and keeping that
character, undoes both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Four bytes a code point, and the letter A in them.
WIDE, MARK = "UTF-32", b"\0\0\0A"
OPEN, MID, NEXT, CLOSE = "### ", ": ", "<|next|>", "</turn>\n"
#: Control strings and what they become inside a text; CLOSE without its line end, so that a text's last characters cannot complete it.
ESCAPES = [("\\", "\\\\"), ("### ", "#\\## "), ("<|next|>", "<\\|next|>"), ("</turn>", "<\\/turn>")]


def escape(text: Column) -> Column:
    for old, new in ESCAPES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(MID), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted string, loss array<struct<start int, stop int>> (code points of formatted).

    Turns are sorted by (turn, role, text), nulls first, so ties and repeated
    rows give the same output whatever their order; all of them stay. A null
    role or text counts as empty. Rows with a null conv_id form one
    conversation. An empty table gives no row. Other columns are ignored. The
    loss spans cover each text of loss_role, not its header or separators. A
    conversation is one output value, so it has to fit in one row.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    role_at = lambda i: F.element_at(F.col("t"), i.cast("int"))["role"]
    # index of the first turn of each block of one role
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (role_at(i) != role_at(F.greatest(i - 1, F.lit(1)))))
    blocks = F.transform(
        F.col("starts"),
        lambda s, k: F.struct(
            role_at(s).alias("role"),
            F.transform(
                F.slice(F.col("t"), s, F.coalesce(F.get(F.col("starts"), k + 1), F.size("t") + 1) - s),
                lambda x: escape(x["text"]),
            ).alias("texts"),
        ),
    )
    head = lambda b: F.concat(F.lit(OPEN), escape_role(b["role"]), F.lit(MID))
    # one entry per text: what stands before it since the last text's end, itself, whether it is under the loss
    parts = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.transform(
                b["texts"],
                lambda x, i: F.struct(
                    F.when(i > 0, F.lit(NEXT)).otherwise(F.concat(F.when(k > 0, F.lit(CLOSE)).otherwise(F.lit("")), head(b))).alias("gap"),
                    x.alias("text"),
                    (b["role"] == loss_role).alias("on"),
                ),
            ),
        )
    )
    # places in the output are running sums; window and aggregation keep the partitioning of the first one
    upto = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        sorted_turns.withColumn("starts", starts)
        .withColumn("blocks", blocks)
        .select("conv_id", F.posexplode(parts).alias("at", "part"))
        .withColumn("stop", F.sum(F.length("part.gap") + F.length("part.text")).over(upto).cast("int"))
    )
    piece = F.struct("at", F.concat("part.gap", "part.text").alias("piece"), F.when(F.col("part.on"), F.struct((F.col("stop") - F.length("part.text")).alias("start"), "stop")).alias("span"))
    done = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return done.select(
        "conv_id",
        F.concat(F.array_join(F.col("p.piece"), ""), F.lit(CLOSE)).alias("formatted"),
        F.filter(F.col("p.span"), lambda s: s.isNotNull()).alias("loss"),
    )


def parse_formatted(formatted: Column) -> Column:
    """Read turns back: array<struct<role, text>>, one entry per original turn."""
    blocks = F.filter(F.split(formatted, CLOSE.replace("|", r"\|")), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, MID) + len(MID), F.length(b)), NEXT.replace("|", r"\|"), -1),
                lambda x: F.struct(unescape(F.substring(b, F.lit(len(OPEN) + 1), F.instr(b, MID) - len(OPEN) - 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss spans, unescaped, in order.

    The spans are cut out of four bytes a code point, where a place needs no
    counting from the start. MARK stands before each, as a reader would take a
    text's own first U+FEFF for a byte order mark.
    """
    cut = lambda wide, s: F.decode(F.concat(F.lit(MARK), F.substring(wide, s["start"] * 4 + 1, (s["stop"] - s["start"]) * 4)), WIDE)
    once = F.transform(F.array(F.encode(formatted, WIDE)), lambda wide: F.transform(loss, lambda s: unescape(F.substring(cut(wide, s), F.lit(2), s["stop"] - s["start"]))))
    return F.array_join(F.get(once, F.lit(0)), "")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations plus number -7, whose texts hold control strings; digests are read back from the formatted output."""
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_conversations(turns).select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("back"), loss_text(F.col("formatted"), F.col("loss")).alias("lost"))
    turn_text = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turn_text.cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), esc AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '<|next|>', '<\|next|>'), '</turn>', '<\/turn>') AS body,
    replace(replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '<|next|>', '<\|next|>'), '</turn>', '<\/turn>'), ': ', ':\ ') AS head,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS fresh
  FROM src
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN fresh THEN length(head) + 14 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""

r"""Operator 3, chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. If
a conversation doesn't end with an assistant turn, one more example holds all its turns and trains nothing, so that the
output keeps every turn.

A turn is written ``<|start|>ROLE<|message|>TEXT<|end|>``. Inside roles and texts a backslash is doubled and ``<|``
becomes ``<\|``, so no control string can occur there; dropping the first of each pair restores them.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role, then text, so ties have
one order; a null conversation id is a conversation of its own; repeated rows are turns like any other; an empty table
gives an empty result; further columns of the input are not carried.

An example holds its whole context, so an example is as long as its conversation and the output of a conversation grows
with the square of its turns: that is the method's own output. Only turns are gathered before that, never examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"


def escape(text: Column) -> Column:
    slashes = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(slashes, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), escape(turn["role"]), F.lit(MESSAGE), escape(turn["text"]), F.lit(END))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, target, formatted, loss_start, loss_length): target is the turn's place from 1, null if none is trained.

    The loss mask is code points loss_start (from 0) to loss_start + loss_length of ``formatted``.
    """
    empty = F.lit("")
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), empty).alias("role"),
        F.coalesce(F.col(text_col), empty).alias("text"),
    )
    convs = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    parts = convs.select(
        "conv_id",
        F.transform("turns", _rendered).alias("parts"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("answers"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("lengths"),
    )
    last = F.size("parts")
    places = F.filter(
        F.sequence(F.lit(1), last), lambda i: F.element_at("answers", i) | (i == last)
    )
    examples = parts.withColumn("place", F.explode(places))
    trained = F.element_at("answers", F.col("place"))
    text = F.array_join(F.slice("parts", F.lit(1), F.col("place")), "")
    length = F.when(trained, F.element_at("lengths", F.col("place"))).otherwise(0)
    return examples.select(
        "conv_id",
        F.when(trained, F.col("place")).alias("target"),
        text.alias("formatted"),
        length.alias("loss_length"),
    ).select(
        "conv_id",
        "target",
        "formatted",
        F.when(F.col("target").isNotNull(), F.length("formatted") - len(END) - F.col("loss_length"))
        .otherwise(0)
        .alias("loss_start"),
        "loss_length",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: what the contract asks for."""
    loss = unescape(F.expr("substring(formatted, loss_start + 1, loss_length)"))
    gathered = (
        examples.withColumn("chars", F.length("formatted"))
        .groupBy("conv_id")
        .agg(
            F.max_by("formatted", "chars").alias("whole"),
            F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", loss.alias("loss"))))).alias(
                "losses"
            ),
            F.sum("chars").cast("long").alias("formatted_chars"),
        )
    )
    pieces = F.filter(F.split("whole", r"<\|end\|>"), lambda p: p != "")
    role = lambda p: unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), MESSAGE, 1))
    text = lambda p: unescape(F.substring_index(p, MESSAGE, -1))
    turns = F.transform(pieces, lambda p: F.concat(role(p), F.lit("\n"), text(p), F.lit("\n")))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"),
        turns.alias("turns"),
        "formatted_chars",
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return read_back(format_chats(turns.unionByName(extra)))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS last,
         sum(27 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))
           OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS so_far
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(so_far) FILTER (role = 'assistant' OR i = last)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

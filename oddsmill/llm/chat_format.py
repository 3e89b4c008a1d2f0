r"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted. Adjacent turns of one role share a block:

    <|role|>ROLE<|text|>TEXT<|next|>TEXT<|end|>

Inside roles and texts a backslash is doubled, then ``<|`` becomes ``<\|``, so no control string can stand in a text
and both steps can be undone. The loss mask is a string of the length of the output, 1 over each assistant text.
Every step is linear in the length of a conversation; each text is escaped before the shuffle. A conversation is one
output row and hence one task's work, however it is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask for every conversation.

    Null texts and roles are empty. Turns are ordered by turn (null first), then role, then text, so ties and repeated rows have one
    result; repeated rows are turns of their own. Rows without conv_id are one conversation. Further columns are ignored.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turn = F.struct("turn", "role", "text", escaped(F.col("role")).alias("safe_role"), escaped(F.col("text")).alias("safe"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    starts = F.transform("turns", lambda t, i: (i == 0) | (F.get("turns", i - 1)["role"] != t["role"]))
    turns = turns.withColumn("starts", starts)
    # what stands before each turn's text: the end of the last block and a new head, or a separator
    head = F.zip_with(
        "turns",
        "starts",
        lambda t, s: F.when(s, F.concat(F.lit(END + ROLE), t["safe_role"], F.lit(TEXT))).otherwise(F.lit(NEXT)),
    )
    turns = turns.withColumn("heads", head)
    body = F.array_join(F.zip_with("heads", "turns", lambda h, t: F.concat(h, t["safe"])), "")
    zero, one = F.lit("0"), F.lit("1")
    mask = F.array_join(
        F.zip_with("heads", "turns", lambda h, t: F.concat(F.repeat(zero, F.length(h)), F.repeat(F.when(t["role"] == LEARNED, one).otherwise(zero), F.length(t["safe"])))),
        "",
    )
    return turns.select(
        "conv_id",
        # the first block has no block before it to end
        F.concat(F.substr(body, F.lit(len(END) + 1)), F.lit(END)).alias("formatted"),
        F.concat(F.substr(mask, F.lit(len(END) + 1)), F.lit("0" * len(END))).alias("loss_mask"),
    )


def running_sums(sizes: Column, start: Column) -> Column:
    """What stands before each size. An array grows by a copy, so this is for few sizes."""
    state = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, state, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")))["out"]


def under_mask(piece: Column, mask: Column) -> Column:
    """The characters of a piece whose mask is 1; a piece under one value, as all are here, is taken or left whole."""
    one_by_one = F.zip_with(F.regexp_extract_all(piece, F.lit("(?s)(.)"), 1), F.regexp_extract_all(mask, F.lit("(.)"), 1), lambda c, b: F.when(b == "1", c))
    return F.when(~F.contains(mask, F.lit("1")), "").when(~F.contains(mask, F.lit("0")), piece).otherwise(F.array_join(one_by_one, ""))


def loss_text(output: DataFrame) -> DataFrame:
    """output with loss_text: all text under the mask, unescaped.

    The output is cut at its control strings, which are pieces too. Of each piece the mask is read as bytes, at once from its place. The places are running
    sums, in runs of about the square root of their number.
    """
    control = r"<\|(?:role|text|next|end)\|>"
    out = output.withColumn("_pieces", F.split("formatted", rf"(?={control})|(?<={control})"))
    out = out.withColumn("_sizes", F.transform("_pieces", F.length))
    out = out.withColumn("_run", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("_sizes"))).cast("int")))
    last = F.floor((F.size("_sizes") - 1) / F.col("_run")).cast("int")
    out = out.withColumn("_runs", F.transform(F.sequence(F.lit(0), last), lambda r: F.slice("_sizes", r * F.col("_run") + 1, F.col("_run"))))
    out = out.withColumn("_bases", running_sums(F.transform("_runs", lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x)), F.lit(0)))
    out = out.withColumn("_places", F.flatten(F.zip_with("_runs", "_bases", running_sums)))
    mask = lambda piece, place: F.substr(F.col("loss_mask").cast("binary"), place + 1, F.length(piece)).cast("string")
    text = F.array_join(F.zip_with("_pieces", "_places", lambda piece, place: unescaped(under_mask(piece, mask(piece, place)))), "")
    return out.withColumn("loss_text", text).drop("_pieces", "_sizes", "_run", "_runs", "_bases", "_places")


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, formatted, turns array<struct<role,text>> and loss_text, from the formatted strings and their masks alone."""
    blocks = F.filter(F.split("formatted", r"<\|role\|>"), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.regexp_replace(b, r"<\|end\|>$", ""), r"<\|text\|>"))
    turns = F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.split(F.get(p, F.lit(1)), r"<\|next\|>"),
                lambda t: F.struct(unescaped(F.get(p, F.lit(0))).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )
    return loss_text(output).select("conv_id", "formatted", turns.alias("turns"), "loss_text")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    back = read_back(formatted(conversations))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts hold control strings of a common template.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]

SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS safe, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS safe_role,
    row_number() OVER w AS rn, coalesce(lag(role) OVER w <> role, true) AS starts
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(safe) + sum(CASE WHEN starts THEN 23 + safe_role ELSE 8 END))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

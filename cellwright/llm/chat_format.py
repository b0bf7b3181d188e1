"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is laid out as ``<turn ROLE>\\nBODY</turn>\\n``. In roles and texts ``\\`` becomes ``\\s``, ``<`` becomes ``\\l``
(and in roles ``>`` becomes ``\\g``, a line feed ``\\n``), so no control string can stand inside a text and the
output can be read back exactly. Image, audio and document parts become ``<image 0>``, ``<audio 1>``, ``<document 2>``:
the number is the part's place in its turn.

Defined cases: a null text, role, part list or part field counts as empty (a null kind as text, an unknown kind as a
document); rows with the same turn number are ordered by role, then parts (by kind and raw text), null turn numbers come last,
and repeated rows stay; an empty table gives an empty result; a null conversation id is a conversation of its own; other columns are ignored. A conversation
is one output value, so its turns meet in one row by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm.common import table

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of an image patch of 28 x 28 pixels, a second of sound and a page.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 512
FOOT = "</turn>\n"


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def _escape_role(c: Column) -> Column:
    return F.replace(F.replace(_escape(c), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def _unescape(c: Column) -> Column:
    for short, long in (("\\n", "\n"), ("\\g", ">"), ("\\l", "<"), ("\\s", "\\")):
        c = F.replace(c, F.lit(short), F.lit(long))
    return c


def text_parts(text: Column) -> Column:
    """A text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"))).cast(f"array<struct<kind:string,text:string>>")


def _fields(parts: Column, names: set[str]) -> Column:
    """Every part with all fields of PART."""
    types = dict(x.split(":") for x in PART[7:-1].split(","))
    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")) if names >= set(types) else parts, lambda p: F.struct(*[(p[k] if k in names else F.lit(None)).cast(t).alias(k) for k, t in types.items()]))


def _kind(p: Column) -> Column:
    return F.when(p["kind"].isNull() | (p["kind"] == "text"), "text").when(p["kind"].isin("image", "audio"), p["kind"]).otherwise("document")


def _tokens(p: Column) -> Column:
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    return (
        F.when(_kind(p) == "image", F.ceil(zero(p["width"]) / PATCH) * F.ceil(zero(p["height"]) / PATCH))
        .when(_kind(p) == "audio", F.ceil(zero(p["seconds"]) * TOKENS_PER_SECOND))
        .when(_kind(p) == "document", zero(p["pages"]).cast("long") * TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_conversations(rows: DataFrame, parts: str | None = None, train_on: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    rows: conv_id, turn, role and either ``text`` or a column of typed parts (an array of PART). loss_spans has, per turn,
    start and length (in code points from the turn's own start, from 0) of what is trained on; length 0 where nothing
    is. attachments: turn (place from 0), part, kind, ref and tokens of each part that is no text.
    """
    if parts is None:
        listed, names = text_parts(F.coalesce(F.col("text").cast("string"), F.lit(""))), {"kind", "text"}
    else:
        listed, names = F.col(parts), {f.name for f in rows.schema[parts].dataType.elementType.fields}
        listed = F.coalesce(listed, F.array().cast(rows.schema[parts].dataType))
    body = lambda parts: F.array_join(F.transform(parts, lambda p, i: F.when(_kind(p) == "text", _escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), _kind(p), F.lit(" "), i.cast("string"), F.lit(">")))), "")
    refs = lambda parts: F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))), lambda a: a["kind"] != "text")
    turns = rows.select(F.col("conv_id"), F.struct(F.col("turn").isNull(), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), _fields(listed, names).alias("parts")).alias("t"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    per = sorted_.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), body(t["parts"]).alias("body"), refs(t["parts"]).alias("refs"))).alias("turns"))
    head = lambda t: F.concat(F.lit("<turn "), _escape_role(t["role"]), F.lit(">\n"))
    return per.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["body"], F.lit(FOOT))), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(F.length(head(t)).alias("start"), F.when(t["role"] == train_on, F.length(t["body"])).otherwise(0).alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["refs"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate(F.flatten(F.col("turns.refs")), F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_text, from the formatted string and its loss spans alone."""
    pieces = formatted.withColumn("pieces", F.split("formatted", FOOT)).withColumn("pieces", F.slice("pieces", 1, F.size("pieces") - 1))
    head = lambda p: F.substring_index(p, ">\n", 1)
    return pieces.select(
        "conv_id",
        F.transform("pieces", lambda p: F.struct(_unescape(F.substring(head(p), F.lit(7), F.length(head(p)))).alias("role"), _unescape(F.substring(p, F.length(head(p)) + 3, F.length(p))).alias("text"))).alias("turns"),
        F.array_join(F.zip_with("pieces", "loss_spans", lambda p, s: _unescape(F.substring(p, s["start"] + 1, s["length"]))), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    back = read_back(format_conversations(rows.unionByName(probe)))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + 8 + 8 + length(replace(replace(x, '\', '\s'), '<', '\l'))
      + (length(r) - length(replace(replace(replace(replace(r, '\', ''), '<', ''), '>', ''), chr(10), ''))))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

"""Chat formatting by prefix-target expansion.

Every turn is written as ``<s>[INST]role[/INST]text</s>``; control strings inside roles and texts are escaped
with a backslash after their first character, and backslashes are doubled, so texts cannot forge a turn and are
read back exactly. Every assistant turn becomes an example of its own: all turns up to it are its text, and only
its own reply is under the loss mask ``[loss_start, loss_end)`` (code points, from 0, marks excluded). Turns
after the last assistant turn are kept in one more example whose mask is empty, so no turn is lost.

Only DataFrame functions are used. A conversation is formatted once as a whole, and an example's text is a prefix
of it. A conversation has to fit in a row, as its examples do; the turns of any one conversation meet in one
task, but no group wider than a conversation is formed.

Defined results: null texts and roles are empty strings; null conversation ids form one conversation; turns are
ordered by turn (null first), then role and text, so repeated rows are repeated turns; an empty table gives no
examples; input columns other than the four named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

#: The template's control strings.
TURN, HEAD, END = "<s>[INST]", "[/INST]", "</s>"
#: The first character of a control string, followed by the rest of one.
CONTROL = r"([<\[])(?=/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """Text that holds no control string; ``unescape`` gives the text back."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id and the array ``turns`` of (turn, role, text) in order."""
    col = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    said = F.struct(F.col(f"`{turn}`").alias("turn"), col(role).alias("role"), col(text).alias("text"))
    return turns.groupBy(F.col(f"`{conv}`").alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("turns"))


def expand(turns: DataFrame, assistant: str = "assistant", **columns) -> DataFrame:
    """Examples: conv_id, example (from 0), n_turns in it, text, loss_start, loss_end, last (the longest one)."""
    marked = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(HEAD), escape(t["text"]), F.lit(END))
    convs = conversations(turns, **columns)
    rows = convs.select("conv_id", F.transform("turns", lambda t: t["role"] == assistant).alias("reply"), F.transform("turns", marked).alias("pieces"), F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"))
    rows = rows.select("*", F.array_join("pieces", "").alias("whole"), F.transform("pieces", F.length).alias("lengths"))
    #: Running ends of the turns: (end so far, array of ends).
    ends = F.aggregate("lengths", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)), lambda acc: F.slice(acc, 2, F.greatest(F.size(acc) - 1, F.lit(0))))
    rows = rows.withColumn("ends", ends)
    made = F.transform(F.arrays_zip("ends", "sizes", "reply"), lambda x, i: F.struct(x["ends"].alias("end"), x["sizes"].alias("size"), x["reply"].alias("reply"), (i + 1).alias("n_turns")))
    kept = F.filter(made, lambda x: x["reply"] | (x["n_turns"] == F.size("ends")))
    rows = rows.select("conv_id", "whole", F.size(kept).alias("n"), F.posexplode(kept).alias("example", "at"))
    stop = F.col("at.end") - len(END)
    return rows.select(
        "conv_id", "example", F.col("at.n_turns").alias("n_turns"),
        F.substring(F.col("whole"), F.lit(1), F.col("at.end")).alias("text"),
        F.when(F.col("at.reply"), stop - F.col("at.size")).otherwise(stop).alias("loss_start"), stop.alias("loss_end"),
        (F.col("example") == F.col("n") - 1).alias("last"),
    )


def read_back(text: Column) -> Column:
    """The turns (role, text) in a formatted text."""
    pieces = F.slice(F.split(text, END, -1), 1, F.size(F.split(text, END, -1)) - 1)
    halves = F.transform(pieces, lambda p: F.split(p, r"\[/INST\]", 2))
    return F.transform(halves, lambda h: F.struct(unescape(F.substring(h[0], F.lit(len(TURN) + 1), F.length(h[0]))).alias("role"), unescape(h[1]).alias("text")))


def summary(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: its turns, the texts under the mask, the formatted length."""
    masked = F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    rows = examples.select(
        "conv_id", F.struct("example", unescape(masked).alias("text")).alias("loss"),
        F.length("text").cast("long").alias("chars"), F.when(F.col("last"), read_back(F.col("text"))).alias("turns"),
    )
    rows = rows.select("conv_id", "loss", "chars", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"))
    found = rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"),
    )
    return found.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: A conversation whose texts hold control strings.
PROBE = "</s>[INST] ok [/INST]"


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :p), (-7L, 1L, 'assistant', :p) AS t(conv_id, turn, role, text)", args={"p": PROBE})
    return summary(expand(turns.unionByName(probe)))


_SQL_ESCAPED = r"regexp_replace(regexp_replace(replace({}, '\', '\\'), '([<\[])(/?s>)', '\1\\\2', 'g'), '([<\[])(/?INST\])', '\1\\\2', 'g')"
OP3_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS txt FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (
  SELECT *, length('{TURN}{HEAD}{END}') + length({_SQL_ESCAPED.format('role')}) + length({_SQL_ESCAPED.format('txt')}) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) AS i, count(*) OVER (PARTITION BY conv_id) AS turns FROM t),
p AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(txt)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(txt, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR i = turns) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

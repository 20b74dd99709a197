r"""Chat formatting: conversations become one marked string each, with Spark expressions only.

Template: <|turn|>ROLE<|text|>TEXT<|end|> for each run of turns of one role; turns of one role that follow each other
share such a block, with <|next|> between their texts. Each control string, and also those of other common templates
(<s>, </s>, [INST], [/INST], anything that starts with <|), is escaped inside roles and texts by a backslash after its
first character; strings that look escaped already get one more backslash, so that unescaping restores every text.

Turns are collected per conversation with partial aggregation, sorted as structs, and joined from array elements in
one pass. A conversation is one output value, so its turns meet in one row; nothing else is gathered.

Defined results: null text or role is empty; null conv_id is one conversation; turns with equal numbers are ordered by
role and text, null turn numbers first; repeated rows are repeated turns; an empty table gives an empty result. The query
adds conversation -1; turns of a conversation -1 that the table has already are merged with it. Texts under the loss mask
are those of the blocks whose role is LOSS_ROLE, without the marks around and between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import read

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: What may follow the first character of a control string.
_REST = r"(\||/?s>|/?INST\])"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[])(\\*)" + _REST, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + _REST, "$1$2$3")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id and formatted, one row per conversation, from rows of conv_id, turn, role and text."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    turns = rows.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    same = lambda i: (i > 0) & (F.get("turns", i - 1)["role"] == F.get("turns", i)["role"])
    piece = lambda t, i: F.when(same(i), F.concat(F.lit(NEXT), t["text"])).otherwise(F.concat(F.when(i > 0, END).otherwise(""), F.lit(TURN), t["role"], F.lit(TEXT), t["text"]))
    return turns.select("conv_id", F.concat(F.array_join(F.transform("turns", piece), ""), F.lit(END)).alias("formatted"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, and turns, an array of (role, text), read back from the formatted string alone."""
    split = lambda c, mark: F.split(c, mark.replace("|", r"\|"))
    blocks = F.filter(split(F.col("formatted"), END), lambda b, i: b != "")
    halves = formatted.withColumn("__blocks", F.transform(blocks, lambda b: split(F.substring(b, len(TURN) + 1, 2147483647), TEXT)))
    turns = F.transform("__blocks", lambda h: F.transform(split(F.get(h, 1), NEXT), lambda t: F.struct(unescape(F.get(h, 0)).alias("role"), unescape(t).alias("text"))))
    return halves.withColumn("turns", F.flatten(turns)).drop("__blocks")


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, read back and digested."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = parse_conversations(format_conversations(rows.unionByName(own)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    out = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_ESCAPED = r"regexp_replace(coalesce({}, ''), '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g')"
SQL = {
    "op3_chat": f"""
    WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_ESCAPED.format("role")} AS erole, {_ESCAPED.format("text")} AS etext FROM
                     (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    marked AS (SELECT *, coalesce(erole = lag(erole) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, erole, etext), false) AS same FROM turns)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, erole, etext)) AS turns_sha256,
           CAST(length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, erole, etext) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, erole, etext) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length(etext) + CASE WHEN same THEN 8 ELSE 23 + length(erole) END) AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id"""
}
QUERIES = {"op3_chat": op3_chat}

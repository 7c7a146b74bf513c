"""Chat formatting with Spark expressions only: relational, reversible, with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template (fixed values).
TURN, END, OPEN, CLOSE, NEXT = "<s>", "</s>", "[INST]", "[/INST]", "[SEP]"
CONTROL = (TURN, END, OPEN, CLOSE, NEXT)
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """Double each backslash, then part each control string by one after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in CONTROL:
        out = F.replace(out, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted.

    A conversation's turns are collected as structs and sorted; neighbours of one role
    merge into a block, `<s>role[INST]text[SEP]text[/INST]`, or for the assistant
    `<s>assistant[/INST]text</s>`. Roles and texts are escaped, so that control strings
    stand at marks only and parse_chats reads every turn back.

    Null text and null role are empty; rows of one turn number are ordered by role and
    text; repeated rows are turns of their own; null conv_id is a conversation; no rows
    give no rows. Other columns are not read. A conversation must fit one row, as its
    formatted text does.
    """
    one = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    convs = turns.select(F.col(conv_col).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    first = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    convs = convs.withColumn("at", first)
    length = lambda s, k: F.coalesce(F.get("at", k + 1), F.size("t")) - s
    blocks = F.transform("at", lambda s, k: F.slice("t", s + 1, length(s, k)))

    def block(b: Column) -> Column:
        role = F.get(b, F.lit(0))["role"]
        learned = role == LEARNED
        texts = F.array_join(F.transform(b, lambda t: escape(t["text"])), NEXT)
        return F.concat(F.lit(TURN), escape(role), F.when(learned, CLOSE).otherwise(OPEN), texts, F.when(learned, END).otherwise(CLOSE))

    return convs.select("conv_id", F.array_join(F.transform(blocks, block), "").alias("formatted"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """Read formatted back: conv_id, formatted, turns (role, text), loss_text.

    loss_text is what the loss mask covers, unescaped: the assistant's texts in order.
    """

    def turns(block: Column) -> Column:
        learned = F.endswith(block, F.lit(END))
        opens, closes = F.when(learned, CLOSE).otherwise(OPEN), F.when(learned, END).otherwise(CLOSE)
        role = F.split_part(block, opens, F.lit(1))
        head = F.length(role) + F.length(opens)
        body = F.substring(block, head + 1, F.length(block) - head - F.length(closes))
        return F.transform(F.split(body, r"\[SEP\]"), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    blocks = F.filter(F.split("formatted", TURN), lambda b: b != "")
    out = chats.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["role"] == LEARNED), lambda t: t["text"])
    return out.withColumn("loss_text", F.array_join(loss, ""))


def digest(parsed: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
    return x


ORACLE = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), cut AS (
  SELECT *,
    CASE WHEN opens THEN '{TURN}' || {_sql_escape("role")} || CASE WHEN role = '{LEARNED}' THEN '{CLOSE}' ELSE '{OPEN}' END ELSE '{NEXT}' END
    || {_sql_escape("text")}
    || CASE WHEN NOT closes THEN '' WHEN role = '{LEARNED}' THEN '{END}' ELSE '{CLOSE}' END AS piece
  FROM marked
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LEARNED}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM cut GROUP BY conv_id
"""

"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions.

Method: the turns of a conversation are ordered and each becomes three segments: the template's opening for its
role, the escaped text, the closing. A segment has a loss flag, which the template sets for the texts of a role. The
machine walks the roles from START by the allowed transitions; a conversation that has no turn, meets a
forbidden transition or stops outside the final states is marked as not valid, and is formatted all the same.

Escaping: in texts, ~ becomes ~0, < becomes ~1 and [ becomes ~2 (in a free role name also ] becomes ~3), so no
text holds a control string, all of which begin with < or [, and unescaping gives back the text exactly.

Cases: null texts and roles are empty; roles outside the template get a marker that carries their name, without
loss; rows of null conv_id make one conversation; null turns come first; turns of equal number go by role,
then text, and repeated rows stay; an empty table gives no rows; extra columns are ignored.

Scale: a conversation is one output row, so it meets in one task; one shuffle of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: role: (opening, closing, loss on the text)
TEMPLATE = {"system": ("<<SYS>>\n", "\n<</SYS>>\n", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s>", "</s>", True)}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
#: state: {role: next state}
TRANSITIONS = {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
FINAL = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("~3"), F.lit("]")), F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def _by_role(role: Column, pick, other: Column) -> Column:
    out = None
    for name, entry in TEMPLATE.items():
        out = (F.when(role == name, pick(entry)) if out is None else out.when(role == name, pick(entry)))
    return out.otherwise(other)


def formatted(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, valid, segments (array of text and loss) and formatted, their texts joined."""
    plain = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    open_ = _by_role(F.col("role"), lambda e: F.lit(e[0]), F.concat(F.lit(OTHER[0]), F.replace(escape(F.col("role")), F.lit("]"), F.lit("~3")), F.lit(OTHER[1])))
    close = _by_role(F.col("role"), lambda e: F.lit(e[1]), F.lit(OTHER[2]))
    loss = _by_role(F.col("role"), lambda e: F.lit(e[2]), F.lit(False))
    row = plain.select("conv_id", F.struct("turn", "role", "text", open_.alias("open"), close.alias("close"), loss.alias("loss"), escape(F.col("text")).alias("body")).alias("t"))
    whole = row.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(segment(t["open"], F.lit(False)), segment(t["body"], t["loss"]), segment(t["close"], F.lit(False)))))

    def step(state: Column, t: Column) -> Column:
        out = F.lit("error")
        for name, nexts in TRANSITIONS.items():
            for r, to in nexts.items():
                out = F.when((state == name) & (t["role"] == r), F.lit(to)).otherwise(out)
        return out

    end = F.aggregate("turns", F.lit("start"), step)
    out = whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), end.isin(*FINAL).alias("valid"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


_PATTERN = r"(<<SYS>>\n|\[INST\] |<s>|\[ROLE ([^\]\[<]*)\] )([^<\[]*)(?:\n<</SYS>>\n| \[/INST\]|</s>| \[/ROLE\])"


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation, read back: an array of role and text."""
    part = lambda k: F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(k))
    role = lambda z: F.when(z["0"] == TEMPLATE["system"][0], "system").when(z["0"] == TEMPLATE["user"][0], "user").when(z["0"] == TEMPLATE["assistant"][0], "assistant").otherwise(unescape(z["1"]))
    return F.transform(F.arrays_zip(part(1).alias("0"), part(2).alias("1"), part(3).alias("2")), lambda z: F.struct(role(z).alias("role"), unescape(z["2"]).alias("text")))


def with_control(turns: DataFrame) -> DataFrame:
    """The conversations with one more, -1, whose texts are made of control strings."""
    extra = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = formatted(with_control(table(spark, sf_dir, "conversations")))
    back = done.withColumn("read", parsed(F.col("formatted"))).withColumn("learned", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""))
    return back.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '~', ''), '<', ''), '[', '')) n,
             CASE role WHEN 'system' THEN 8 + 10 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 3 + 4
                  ELSE 6 + 2 + 8 + 2 * length(role) - length(replace(replace(replace(replace(role, '~', ''), '<', ''), '[', ''), ']', '')) END m,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) was,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) back FROM c)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) loss_sha256,
       CAST(sum(n + m) AS BIGINT) formatted_chars,
       bool_and((was IS NULL AND role IN ('system', 'user')) OR (was = 'system' AND role = 'user') OR (was = 'user' AND role = 'assistant') OR (was = 'assistant' AND role = 'user'))
         AND bool_or(back = 1 AND role = 'assistant') valid
FROM e GROUP BY conv_id
"""

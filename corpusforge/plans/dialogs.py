"""Queries about dialogues.

``conversations`` never repeats a speaker in consecutive turns, so turns are
merged on ``events``: users as conversations, event types as speakers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.tokens import truncate
from corpusforge.operators import dialog as D
from corpusforge.operators import schema as S
from corpusforge.plans.registry import joined, query, table, trim_sql

RUNS = """
WITH marked AS (
  SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (
  SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM marked),
runs AS (
  SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS speaker,
         string_agg(props, ' ' ORDER BY ts, event_id) AS text
  FROM numbered GROUP BY user_id, run)
"""
FIRST = """
firsts AS (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t, e) - 1 AS n
  FROM (SELECT user_id, event_type, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e
        FROM events GROUP BY user_id, event_type))
"""
# Transcripts in the form of a dialogue corpus, "{n} : {text}" per line.
TRANSCRIPTS = """
transcripts AS (
  SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '0' WHEN 'assistant' THEN '1' ELSE '4' END
         || ' : ' || text, chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id)
"""
MARKED = """
marked AS (
  SELECT conv_id, replace(replace(replace(replace(replace(replace(text, chr(10), '</s>' || chr(10)),
         '0 : ', '<unused1>'), '1 : ', '<unused2>'), '2 : ', '<unused3>'), '3 : ', '<unused4>'),
         '4 : ', '<unused5>') AS text FROM transcripts)
"""


def transcripts(spark, sf) -> DataFrame:
    turns = table(spark, sf, "conversations")
    number = F.when(F.col("role") == "user", "0").when(F.col("role") == "assistant", "1").otherwise("4")
    lines = turns.withColumn("line", F.concat(number, F.lit(" : "), "text"))
    return D.assemble_documents(lines, "conv_id", "turn", "line")


def preferences(spark, sf) -> DataFrame:
    """Preference rows with all turns before the question as context.

    The next conversation's turn of the same number is rejected.
    """
    turns = table(spark, sf, "conversations")
    speaker = F.when(F.col("role") == "user", "human").otherwise("gpt")
    seen = D.earlier_turns(turns, "conv_id", ["turn"], F.struct(
        speaker.alias("from"), F.col("text").alias("value")), "context", skip=1)

    def at(conv: int, turn: int, name: str) -> DataFrame:
        return turns.select((F.col("conv_id") - conv).alias("conv_id"),
                            (F.col("turn") - turn).alias("turn"), F.col("text").alias(name))

    def said(who: str, name: str):
        return F.struct(F.lit(who).alias("from"), F.col(name).alias("value"))

    return (
        seen.where(F.col("role") == "assistant")
        .join(at(0, -1, "asked"), ["conv_id", "turn"])
        .join(at(1, 0, "other"), ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "context",
            said("human", "asked").alias("instruction"),
            said("gpt", "text").alias("chosen"),
            F.struct(F.lit("gpt").alias("from"),
                     F.coalesce("other", F.lit(" \n")).alias("value")).alias("rejected"))
    )


PREFERENCES = """
before AS (
  SELECT a.conv_id, a.turn, coalesce(string_agg(CASE c.role WHEN 'user' THEN 'Human: '
         ELSE 'Assistant: ' END || c.text || chr(10) || chr(10), '' ORDER BY c.turn), '') AS context
  FROM conversations a LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn < a.turn - 1
  WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn),
prefs AS (
  SELECT a.conv_id, a.turn, context || 'Human: ' || b.text AS prompt,
         a.text AS chosen, coalesce(d.text, ' ' || chr(10)) AS rejected
  FROM conversations a JOIN before USING (conv_id, turn)
  JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
  LEFT JOIN conversations d ON d.conv_id = a.conv_id + 1 AND d.turn = a.turn
  WHERE a.role = 'assistant')
"""


@query(f"{RUNS} SELECT user_id, run, speaker, text FROM runs")
def merged_runs(spark, sf):
    return D.merge_runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type",
                        "props")


@query(f"""{RUNS}
SELECT user_id, string_agg(text, chr(10) ORDER BY run) AS text,
       string_agg(speaker, ',' ORDER BY run) AS speakers
FROM runs GROUP BY user_id
""")
def merged_turns(spark, sf):
    turns = D.merge_turns(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type",
                          "props")
    return turns.withColumn("speakers", joined("speakers", ","))


@query("""
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text,
       string_agg(role, ',' ORDER BY turn) AS speakers
FROM conversations GROUP BY conv_id
""")
def merged_conversations(spark, sf):
    turns = D.merge_turns(table(spark, sf, "conversations"), "conv_id", ["turn"], "role", "text")
    return turns.withColumn("speakers", joined("speakers", ","))


@query(f"WITH {FIRST} SELECT event_id, n AS speaker_index FROM events JOIN firsts USING (user_id, event_type)")
def indexed_speakers(spark, sf):
    indexed = D.index_speakers(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"],
                               "event_type")
    return indexed.select("event_id", "speaker_index")


@query(f"""{RUNS}, {FIRST}
SELECT 'dialog-' || runs.user_id AS id,
       string_agg(n || ': ' || text, chr(10) ORDER BY run) AS dialog, count(*) AS depth
FROM runs JOIN firsts ON runs.user_id = firsts.user_id AND speaker = event_type
GROUP BY runs.user_id
""")
def rendered_dialogs(spark, sf):
    indexed = D.index_speakers(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"],
                               "event_type")
    return D.render_dialog(indexed, "user_id", ["ts", "event_id"], "speaker_index", "props",
                           "dialog-")


@query(f"""WITH {TRANSCRIPTS}, {MARKED}
SELECT conv_id, text, CASE WHEN contains(text, '<unused5>') THEN 5
       WHEN contains(text, '<unused4>') THEN 4 WHEN contains(text, '<unused3>') THEN 3
       WHEN contains(text, '<unused2>') THEN 2 ELSE 1 END AS num_users
FROM marked
""")
def marked_dialogs(spark, sf):
    return D.marked_dialog(transcripts(spark, sf))


@query("""
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Human: ' ELSE 'Assistant: ' END
       || text, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def rendered_conversations(spark, sf):
    return D.render_conversation(table(spark, sf, "conversations"), "conv_id", "turn", "role",
                                 "text", human="user")


@query(f"""WITH {PREFERENCES}
SELECT conv_id, turn, prompt || chr(10) || chr(10) || 'Assistant: ' || chosen AS chosen,
       prompt || chr(10) || chr(10) || 'Assistant: ' || rejected AS rejected
FROM prefs WHERE {trim_sql("chosen")} <> '' AND {trim_sql("rejected")} <> ''
""")
def preference_pairs(spark, sf):
    pairs = preferences(spark, sf)
    answered = S.valid_pairs(
        pairs.withColumns({"_c": F.col("chosen.value"), "_r": F.col("rejected.value")}), "_c", "_r")
    return D.preference_texts(answered.drop("_c", "_r"))


@query(f"""WITH {PREFERENCES}
SELECT conv_id, turn, prompt || chr(10) || chr(10) || 'Assistant: ' AS prompt, chosen, rejected
FROM prefs
""")
def seq2seq_pairs(spark, sf):
    return D.render_seq2seq_pair(preferences(spark, sf))


@query("""
SELECT a.conv_id, a.turn, replace(string_agg(b.text, chr(10) ORDER BY b.turn), chr(10), '</s>') || '</s>'
       AS prompt_text, min(a.text) AS label_text
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn < a.turn
GROUP BY a.conv_id, a.turn
""")
def context_responses(spark, sf):
    """Each turn with all turns before it."""
    pairs = D.context_pairs(table(spark, sf, "conversations"), "conv_id", ["turn"], "text")
    return D.context_response(pairs).select("conv_id", "turn", "prompt_text", "label_text")


@query("""
SELECT a.conv_id, a.turn, replace(b.text, chr(10), '</s>') || '</s>' AS prompt_text,
       a.text AS label_text
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
""")
def turn_responses(spark, sf):
    """Each turn with the turn before it."""
    pairs = D.turn_pairs(table(spark, sf, "conversations"), "conv_id", ["turn"], "text")
    return D.context_response(pairs).select("conv_id", "turn", "prompt_text", "label_text")


@query(f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place,
       {trim_sql("CASE role WHEN 'user' THEN '<usr>' WHEN 'assistant' THEN '<bot>' ELSE '<sys>' END || ' ' || text")}
       AS utterance
FROM conversations
""")
def utterances(spark, sf):
    mark = F.when(F.col("role") == "user", "<usr>").when(
        F.col("role") == "assistant", "<bot>").otherwise("<sys>")
    lines = table(spark, sf, "conversations").withColumn(
        "line", F.concat(mark, F.lit(" "), "text"))
    texts = D.assemble_documents(lines, "conv_id", "turn", "line")
    pieces = D.split_utterances(F.col("text"), ["<usr>", "<bot>", "<sys>"])
    return texts.select("conv_id", F.posexplode(pieces).alias("place", "utterance"))


@query("""
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS last_two FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
WHERE r <= 2 GROUP BY conv_id
""")
def truncated_left(spark, sf):
    """The last two turns of each conversation: an array cut on its left side."""
    turns = table(spark, sf, "conversations")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    rows = turns.groupBy("conv_id").agg(texts.alias("texts"))
    return rows.select("conv_id", joined(truncate(F.col("texts"), 2, "left")).alias("last_two"))

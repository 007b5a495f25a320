"""Task pipelines by name: each a spec, compiled to one plan over ids of a learned vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import tokens as K
from corpusforge.operators import vocabulary as V
from corpusforge.operators.dialog import assemble_documents
from corpusforge.operators.schema import min_chars
from corpusforge.operators.tasks import Encoder, Task, prepare
from corpusforge.plans.registry import documents, joined, query, table, words_sql
from corpusforge.plans.tokens import (
    EOS, MAX, PAD, PAIR_TEXTS, SPANS, WORD_PLACES, WORD_VOCAB, joined_sql, pad_sql, pair_rows, span_rows)

ROWS = ("input_ids", "attention_mask", "labels")
MARKS = ("<usr>", "<bot>", "<sys>")

TASKS = {
    "plain_text": Task("causal", template="plain", max_length=MAX, steps=(lambda df: min_chars(df, 8),)),
    "topic_text": Task("causal", template="topic", fields={"label": "source"}, max_length=MAX, pad_side="left"),
    "summary": Task("prompt", ("prompt_text", "label_text"), template="summary", fields={"summary": "source"},
                    max_length=MAX, pad_side="left"),
    "reply": Task("prompt", ("prompt", "chosen"), max_length=MAX, cut_side="left", pad_side="left"),
    "dialogue": Task("turns", marks=MARKS, max_length=MAX),
    "quality_class": Task("classes", label="quality", max_length=MAX),
    "span_tokens": Task("token_labels", max_length=MAX),
    "preference": Task("pairs", ("with_chosen", "with_rejected"), max_length=60, cut_side="left", steps=(
        lambda df: df.withColumns({f"with_{s}": F.concat_ws(" ", "prompt", s) for s in ("chosen", "rejected")}),)),
    "ranked_reply": Task("ranked", ("prompt", "chosen", "rejected"), max_length=40, answer_length=20, cut_side="left"),
}


def word_ids_of(docs: DataFrame) -> Encoder:
    """Words and their ids in the vocabulary of the documents."""
    return Encoder(K.words, V.word_encoder(V.word_vocab(docs)), EOS, PAD)


def examples(spark, sf: str, name: str, rows: DataFrame, keys: list[str], columns=ROWS) -> DataFrame:
    made = prepare(rows, TASKS[name], word_ids_of(documents(spark, sf)))
    return made.select(*keys, *[joined(c).alias(c.replace(".", "_")) for c in columns])


def ids_of(name: str, rows: str, keys: str, text: str) -> str:
    """A table of ``keys`` and ids, from the SQL expression ``text`` over the table ``rows``."""
    return f"""
{name}_words AS (SELECT {keys}, {words_sql(f"coalesce({text}, '')")} AS tok FROM {rows}),
{name} AS (
  SELECT {keys}, coalesce(list(id ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids FROM (
    SELECT {keys}, pos, CASE WHEN pos IS NOT NULL THEN coalesce(v.id, 5) END AS id
    FROM (SELECT {keys}, CASE WHEN tok = [] THEN NULL ELSE unnest(CASE WHEN tok = [] THEN [NULL] ELSE tok END) END AS piece,
                 CASE WHEN tok = [] THEN NULL ELSE unnest(range(greatest(len(tok), 1))) END AS pos FROM {name}_words) w
    LEFT JOIN vocab v ON v.piece = w.piece)
  GROUP BY {keys})"""


def rows_sql(rows: str, key: str, ids: str, labels: str, n: int = MAX, left: bool = False) -> str:
    """Padded arrays of ``rows`` as texts."""
    return f"""
SELECT {key}, {joined_sql(pad_sql(ids, str(n), PAD, left))} AS input_ids,
       {joined_sql(pad_sql(f"list_transform({ids}, lambda x: 1)", str(n), 0, left))} AS attention_mask,
       {joined_sql(pad_sql(labels, str(n), -100, left))} AS labels
FROM {rows}"""


PLAIN_SQL = ids_of("t", "(SELECT doc_id, '<s> ' || text || ' </s>' AS t FROM documents WHERE length(text) >= 8)", "doc_id", "t")


@query(f"WITH {WORD_VOCAB}, {PLAIN_SQL}, c AS (SELECT doc_id, ids[:{MAX}] AS ids FROM t) {rows_sql('c', 'doc_id', 'ids', 'ids')}")
def task_plain_text(spark, sf):
    return examples(spark, sf, "plain_text", documents(spark, sf), ["doc_id"])


TOPIC_SQL = ids_of("t", "documents", "doc_id", "'topic: ' || source || chr(10) || text || ' </s>'")


@query(f"""WITH {WORD_VOCAB}, {TOPIC_SQL}, c AS (SELECT doc_id, ids[:{MAX}] AS ids FROM t)
{rows_sql('c', 'doc_id', 'ids', 'ids', left=True)}""")
def task_topic_text(spark, sf):
    return examples(spark, sf, "topic_text", documents(spark, sf), ["doc_id"])


def prompt_sql(rows: str, keys: str, prompt: str, answer: str, cut: str) -> str:
    return f"""{ids_of("p", rows, keys, prompt)}, {ids_of("a", rows, keys, answer)},
b AS (SELECT {keys}, p.ids{cut} AS p, list_concat(a.ids, [{EOS}]){cut} AS a FROM p JOIN a USING ({keys})),
c AS (SELECT {keys}, p[:{MAX} - len(a)] AS p, a FROM b)
{rows_sql("c", keys, "list_concat(p, a)", "list_concat(list_transform(p, lambda x: -100), a)", left=True)}"""


@query(f"WITH {WORD_VOCAB}, " + prompt_sql(
    "documents", "doc_id", "'내용: ' || text || chr(10) || '요약: '", "source", f"[:{MAX}]"))
def task_summary(spark, sf):
    return examples(spark, sf, "summary", documents(spark, sf), ["doc_id"])


PAIRS = PAIR_TEXTS.replace("p AS", "pair_texts AS", 1)


@query(f"WITH {WORD_VOCAB}, {PAIRS}, " + prompt_sql("pair_texts", "conv_id, turn", "prompt", "chosen", f"[-{MAX}:]"))
def task_reply(spark, sf):
    return examples(spark, sf, "reply", pair_rows(spark, sf), ["conv_id", "turn"])


LINE = "CASE role WHEN 'user' THEN '<usr>' WHEN 'assistant' THEN '<bot>' ELSE '<sys>' END || ' ' || text"


@query(f"""WITH {WORD_VOCAB}, {ids_of("u", "conversations", "conv_id, turn, role", LINE)},
v AS (SELECT conv_id, turn, role = 'assistant' AS bot,
             CASE WHEN role = 'assistant' THEN list_concat(ids[:{MAX}], [{EOS}]) ELSE ids[:{MAX}] END AS ids FROM u),
w AS (SELECT conv_id, flatten(list(ids ORDER BY turn))[:{MAX}] AS ids,
             flatten(list(CASE WHEN bot THEN ids ELSE list_transform(ids, lambda x: -100) END ORDER BY turn))[:{MAX}] AS labels
      FROM v GROUP BY conv_id)
{rows_sql("w", "conv_id", "ids", "labels")} WHERE len(list_filter(labels, lambda x: x <> -100)) > 0""")
def task_dialogue(spark, sf):
    mark = F.when(F.col("role") == "user", "<usr>").when(F.col("role") == "assistant", "<bot>").otherwise("<sys>")
    lines = table(spark, sf, "conversations").withColumn("line", F.concat(mark, F.lit(" "), "text"))
    return examples(spark, sf, "dialogue", assemble_documents(lines, "conv_id", "turn", "line"), ["conv_id"])


@query(f"""WITH {WORD_VOCAB}, {ids_of("t", "documents", "doc_id", "text")},
c AS (SELECT doc_id, quality AS class_labels, ids[:{MAX}] AS ids FROM t JOIN labels USING (doc_id))
SELECT doc_id, class_labels, {joined_sql(pad_sql("ids", str(MAX), PAD))} AS input_ids,
       {joined_sql(pad_sql("list_transform(ids, lambda x: 1)", str(MAX), 0))} AS attention_mask FROM c""")
def task_quality_class(spark, sf):
    docs = documents(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return examples(spark, sf, "quality_class", docs, ["doc_id", "class_labels"], ROWS[:2])


@query(f"""WITH {WORD_VOCAB}, {ids_of("t", "documents", "doc_id", "text")}, {SPANS}, {WORD_PLACES},
m AS (SELECT p.doc_id, pos, max(CASE WHEN s_begin IS NULL THEN 0 ELSE 1 END) AS label
      FROM places p LEFT JOIN spans s ON s.doc_id = p.doc_id AND prob >= 0.5 AND w_end >= s_begin AND s_end >= begin
      GROUP BY p.doc_id, pos),
l AS (SELECT doc_id, list(label ORDER BY pos) AS labels FROM m GROUP BY doc_id),
c AS (SELECT t.doc_id, t.ids[:{MAX}] AS ids, coalesce(l.labels, [])[:{MAX}] AS labels FROM t LEFT JOIN l ON l.doc_id = t.doc_id)
{rows_sql("c", "doc_id", "ids", "labels")}""")
def task_span_tokens(spark, sf):
    docs = documents(spark, sf)
    spans = span_rows(docs).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end", "prob")).alias("spans"))
    return examples(spark, sf, "span_tokens", docs.join(spans, "doc_id", "left"), ["doc_id"])


def sides_sql(*columns: tuple[str, str, int]) -> str:
    """Padded ids and masks: (name, array, length) each."""
    return ", ".join(
        f"""{joined_sql(pad_sql(array, str(n), PAD))} AS {name.replace("*", "input_ids")},
       {joined_sql(pad_sql(f"list_transform({array}, lambda x: 1)", str(n), 0))} AS {name.replace("*", "attention_mask")}"""
        for name, array, n in columns)


@query(f"""WITH {WORD_VOCAB}, {PAIRS}, {ids_of("c", "pair_texts", "conv_id, turn", "prompt || ' ' || chosen")},
{ids_of("r", "pair_texts", "conv_id, turn", "prompt || ' ' || rejected")},
b AS (SELECT conv_id, turn, c.ids[-60:] AS c, r.ids[-60:] AS r FROM c JOIN r USING (conv_id, turn))
SELECT conv_id, turn, {sides_sql(("chosen_*", "c", 64), ("rejected_*", "r", 64))} FROM b""")
def task_preference(spark, sf):
    columns = [f"{side}.{c}" for side in ("chosen", "rejected") for c in ROWS[:2]]
    return examples(spark, sf, "preference", pair_rows(spark, sf), ["conv_id", "turn"], columns)


@query(f"""WITH {WORD_VOCAB}, {PAIRS}, {ids_of("q", "pair_texts", "conv_id, turn", "prompt")},
{ids_of("c", "pair_texts", "conv_id, turn", "chosen")}, {ids_of("r", "pair_texts", "conv_id, turn", "rejected")},
b AS (SELECT conv_id, turn, q.ids[-40:] AS q, c.ids[:20] AS c, r.ids[:20] AS r
      FROM q JOIN c USING (conv_id, turn) JOIN r USING (conv_id, turn))
SELECT conv_id, turn, {sides_sql(("chosen_*", "q", 40), ("chosen_decoder_*", "c", 24), ("rejected_decoder_*", "r", 24))} FROM b""")
def task_ranked_reply(spark, sf):
    columns = [f"{s}.{c}" for s, c in [
        *[("chosen", c) for c in ROWS[:2]],
        *[(s, f"decoder_{c}") for s in ("chosen", "rejected") for c in ROWS[:2]]]]
    return examples(spark, sf, "ranked_reply", pair_rows(spark, sf), ["conv_id", "turn"], columns)

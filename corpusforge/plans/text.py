"""Queries about schemas, cleaning and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.functions.templates import apply_template
from corpusforge.operators import schema as S
from corpusforge.operators.dialog import assemble_documents
from corpusforge.plans.registry import documents, query, table, trim_sql
from corpusforge.values import CLASS_LABELS, EMOJI_CLASS, KEPT_CHARS, URL_PATTERN

LANGS = ["en", "fr", "de", "es"]
LATIN = "a-zA-Z"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("SELECT text FROM documents WHERE length(text) >= 8")
def text_only(spark, sf):
    return S.text_only(documents(spark, sf).withColumnRenamed("text", "content"),
                       min_length=8)


@query("""
SELECT conv_id, turn, replace(replace(replace(replace(role || ' 1 : ' || text,
       '0 : ', ''), '1 : ', ''), '2 : ', ''), '3 : ', '') AS text
FROM conversations
""")
def unify_text(spark, sf):
    turns = table(spark, sf, "conversations")
    dialog = turns.select("conv_id", "turn", F.concat("role", F.lit(" 1 : "), "text").alias("dialog"))
    return S.unify_text(dialog)


@query("""
SELECT conv_id, list_extract(list(text ORDER BY turn), 1) AS title, count(*) AS sentences,
       string_agg(text, ' ' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def explode_documents(spark, sf):
    """Nested records as in a corpus file, one per source of conversations."""
    turns = table(spark, sf, "conversations")
    sentences = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                            lambda t: F.struct(t["text"].alias("sentence")))
    nested = turns.groupBy("conv_id").agg(sentences.alias("content")).select(
        F.array(F.struct(F.struct("conv_id", F.size("content").alias("sentences")).alias("metadata"),
                         F.col("content").alias("title"), "content")).alias("document"))
    text = T.join_parts(F.transform("d.content", lambda s: s["sentence"]), " ")
    return S.explode_documents(nested, "document", "metadata", title=S.first_title(), text=text)


@query("""
SELECT d.doc_id AS id, d.text AS text, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS summary
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def merge_structs(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "label_doc")
    both = documents(spark, sf).join(labels, F.col("doc_id") == F.col("label_doc"), "left")
    parts = both.select(
        F.struct("doc_id", "text", F.col("lang").alias("summary")).alias("a"),
        F.when(F.col("label_doc").isNotNull(), F.struct(
            F.col("quality").cast("string").alias("summary"))).alias("b"))
    return S.merge_structs(parts, ["a", "b"], {"doc_id": "id", "text": "text", "summary": "summary"})


@query("SELECT doc_id, lang AS document FROM documents")
def document_id(spark, sf):
    docs = documents(spark, sf)
    return docs.select("doc_id", T.document_id(F.concat_ws(".", "source", "lang", "doc_id"))
                       .alias("document"))


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS label,
       lang AS name
FROM documents
""")
def class_labels(spark, sf):
    docs = documents(spark, sf)
    coded = docs.select("doc_id", S.encode_label(F.col("lang"), LANGS).alias("label"))
    return coded.withColumn("name", S.decode_label(F.col("label"), LANGS))


@query("SELECT doc_id, toxic AS label, quality AS other FROM labels")
def label_lookup(spark, sf):
    nested = table(spark, sf, "labels").select(
        "doc_id", F.struct(F.col("toxic").alias("binary-label")).alias("labels"),
        F.col("quality").alias("class"))
    first = S.label_from(nested, ["labels.binary-label", "label", "class"])
    return S.label_from(first, ["missing", "class"], "other").select("doc_id", "label", "other")


@query("""
SELECT d.doc_id, 'toxic' AS side, d.text FROM documents d JOIN labels l USING (doc_id)
WHERE l.toxic >= 0.5
UNION ALL
SELECT d.doc_id, 'clean', d.text FROM documents d JOIN labels l USING (doc_id)
WHERE l.toxic < 0.5
""")
def label_sides(spark, sf):
    both = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    sides = [S.filter_label(both, "toxic", 0.5, side).select(
        "doc_id", F.lit(name).alias("side"), "text")
        for side, name in (("above", "toxic"), ("below", "clean"))]
    return sides[0].unionByName(sides[1])


@query("SELECT doc_id, text FROM documents WHERE length(text) > 32 AND length(text) >= 256")
def length_filter(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return S.min_chars(S.min_chars(docs, 33), 256)


@query("SELECT DISTINCT source, text FROM documents")
def dedupe_exact(spark, sf):
    return S.dedupe_exact(documents(spark, sf), ["source", "text"])


@query("""
SELECT doc_id, list_aggregate(list_transform(
       string_split(text, ' '), lambda w: length(w)), 'max') AS longest
FROM documents
WHERE len(list_filter(string_split(text, ' '), lambda w: length(w) > 3)) > 0
""")
def has_supervision(spark, sf):
    lengths = F.transform(F.split("text", " ", -1), lambda w: F.length(w))
    labels = F.transform(lengths, lambda n: F.when(n > 3, n).otherwise(-100))
    docs = documents(spark, sf).select("doc_id", labels.alias("labels"))
    return S.has_supervision(docs).select("doc_id", F.array_max("labels").alias("longest"))


@query(f"""
SELECT doc_id, regexp_replace(text, {sql_text(f"[^{KEPT_CHARS}{EMOJI_CLASS}]+")}, ' ', 'g') AS text
FROM documents
""")
def keep_charset(spark, sf):
    return documents(spark, sf).select(
        "doc_id", T.keep_charset(F.col("text")).alias("text"))


@query(f"""
SELECT page_id, regexp_replace('see ' || url || ' and ' || html, {sql_text(URL_PATTERN)},
       '', 'g') AS text
FROM pages
""")
def strip_urls(spark, sf):
    pages = table(spark, sf, "pages")
    text = F.concat(F.lit("see "), "url", F.lit(" and "), "html")
    return pages.select("page_id", T.strip_urls(text).alias("text"))


COLLAPSED = r"""
array_to_string(list_filter({chars}, lambda c, i: NOT (i > 2 AND c = {chars}[i - 1]
    AND c = {chars}[i - 2] AND regexp_matches(c, '[\p{{L}}\p{{N}}_]'))), '')
"""


@query(rf"""
WITH c AS (SELECT doc_id, string_split(text, '') AS chars FROM documents),
r AS (SELECT doc_id, {COLLAPSED.format(chars="chars")} AS text FROM c)
SELECT doc_id, {trim_sql(r"regexp_replace(text, '[^\S\r\n]+', ' ', 'g')")} AS text FROM r
""")
def collapse_repeats(spark, sf):
    return documents(spark, sf).select(
        "doc_id", T.collapse_repeats(F.col("text")).alias("text"))


@query(rf"""
WITH k AS (SELECT doc_id, {trim_sql(
    f"regexp_replace(regexp_replace(text, {sql_text(f'[^{KEPT_CHARS}{EMOJI_CLASS}]+')}, ' ', 'g'), "
    f"{sql_text(URL_PATTERN)}, '', 'g')")} AS text FROM documents),
c AS (SELECT doc_id, string_split(text, '') AS chars FROM k),
r AS (SELECT doc_id, {COLLAPSED.format(chars="chars")} AS text FROM c)
SELECT doc_id, {trim_sql(r"regexp_replace(text, '[^\S\r\n]+', ' ', 'g')")} AS text FROM r
""")
def clean_text(spark, sf):
    """Full cleaning. The fixtures hold no Hangul; ``emoticons`` looks at that step."""
    return documents(spark, sf).select("doc_id", T.clean(F.col("text")).alias("text"))


@query(f"""
SELECT doc_id, round(1 - length(regexp_replace(text, '[{LATIN}]+', '', 'g')) / length(text), 10)
       AS ratio
FROM documents
WHERE 1 - length(regexp_replace(text, '[{LATIN}]+', '', 'g')) / length(text) > 0.75
""")
def script_filter(spark, sf):
    kept = S.filter_script(documents(spark, sf), 0.75, char_class=LATIN)
    return kept.select("doc_id", F.round(T.script_ratio(F.col("text"), LATIN), 10).alias("ratio"))


@query(rf"""
SELECT doc_id, replace({trim_sql("chr(10) || text || '\\xa0 '")}, '\xa0', '') AS text
FROM documents
""")
def strip_literal_nbsp(spark, sf):
    text = F.concat(F.lit("\n"), "text", F.lit("\\xa0 "))
    return documents(spark, sf).select("doc_id", T.strip_literal_nbsp(text).alias("text"))


@query("""
SELECT conv_id, turn, replace(replace(replace(replace(turn || ' : ' || text,
       '0 : ', ''), '1 : ', ''), '2 : ', ''), '3 : ', '') AS text
FROM conversations
""")
def remove_speaker(spark, sf):
    marked = F.concat(F.col("turn").cast("string"), F.lit(" : "), "text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.remove_speaker(marked).alias("text"))


@query("""
SELECT conv_id, turn, CASE WHEN regexp_full_match(substr(id, 2), '[0-9]+')
       THEN CAST(substr(id, 2) AS BIGINT) ELSE -1 END AS speaker,
       CASE WHEN length(form) = 0 THEN text ELSE form END AS utterance
FROM (SELECT *, CASE WHEN role = 'system' THEN 'Px' ELSE 'P0' || (turn + 9) END AS id,
             CASE WHEN turn % 2 = 0 THEN '' ELSE upper(role) END AS form FROM conversations)
""")
def parse_speaker(spark, sf):
    turns = table(spark, sf, "conversations")
    number = F.concat(F.lit("P0"), (F.col("turn") + 9).cast("string"))
    ids = F.when(F.col("role") == "system", "Px").otherwise(number)
    form = F.when(F.col("turn") % 2 == 0, "").otherwise(F.upper("role"))
    return turns.select("conv_id", "turn", T.parse_speaker(ids).alias("speaker"),
                        T.utterance_or_note(form, F.col("text")).alias("utterance"))


@query("SELECT doc_id, text FROM documents")
def assembled_documents(spark, sf):
    lines = documents(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "form"))
    return assemble_documents(lines, "doc_id", "line", "form")


@query("""
SELECT doc_id, '내용: ' || text || chr(10) || '요약: ' AS prompt_text, source AS label_text
FROM documents
""")
def summary_template(spark, sf):
    docs = documents(spark, sf)
    return apply_template(docs, "summary", {"summary": "source"}).select(
        "doc_id", "prompt_text", "label_text")


@query("""
SELECT conv_id, turn, '<usr>' || role || chr(10) || CASE WHEN turn % 2 = 0 THEN '' ELSE
       text || chr(10) END AS prompt_text, '<sys>' || text AS label_text
FROM conversations
""")
def instruction_template(spark, sf):
    turns = table(spark, sf, "conversations").withColumn(
        "input", F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")))
    return apply_template(turns, "instruction", {"instruction": "role", "output": "text"}).select(
        "conv_id", "turn", "prompt_text", "label_text")


@query(f"""
SELECT doc_id, '제목: ' || source || chr(10) || '아티스트: ' || lang || chr(10) || '가사:'
       || chr(10) || {trim_sql("' ' || text || chr(10)")} || '</s>' AS text
FROM documents
""")
def lyrics_template(spark, sf):
    docs = documents(spark, sf)
    fields = {"title": "source", "artist": "lang",
              "lyrics": F.concat(F.lit(" "), F.col("text"), F.lit("\n"))}
    return apply_template(docs, "lyrics", fields).select("doc_id", "text")


@query(f"""
SELECT d.doc_id, 'topic: ' || CASE l.quality WHEN 1 THEN 'positive' ELSE 'negative' END
       || chr(10) || replace({trim_sql("d.text")}, '\\xa0', '') || '</s>' AS text
FROM documents d JOIN labels l USING (doc_id)
""")
def topic_template(spark, sf):
    both = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    label = S.decode_label(F.col("quality"), CLASS_LABELS["sentiment"])
    return apply_template(both, "topic", {"label": label}).select("doc_id", "text")


@query("""
SELECT doc_id, 'Title: ' || source || chr(10) || 'Content: ' || text AS text FROM documents
""")
def news_template(spark, sf):
    docs = documents(spark, sf)
    return apply_template(docs, "news", {"headline": "source", "description": "text"}).select(
        "doc_id", "text")


@query("""
SELECT a.conv_id, a.turn, '1: ' || a.text || chr(10) || '2:' || b.text AS text
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
""")
def sentence_pair_template(spark, sf):
    turns = table(spark, sf, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"),
                         F.col("text").alias("sentence2"))
    pairs = turns.withColumnRenamed("text", "sentence1").join(after, ["conv_id", "turn"])
    return apply_template(pairs, "sentence_pair").select("conv_id", "turn", "text")


@query(f"""
SELECT doc_id, '<s>' || replace({trim_sql("text")}, '\\xa0', '') || '</s>' AS text FROM documents
""")
def plain_template(spark, sf):
    return apply_template(documents(spark, sf), "plain").select("doc_id", "text")


@query("""
WITH n AS (SELECT doc_id, lang, length(text) % 4 + 1 AS k, length(text) % 3 + 1 AS v FROM documents)
SELECT doc_id, lang || ' ' || repeat('ㅋ', CASE WHEN k + 1 >= 3 THEN 2 ELSE k + 1 END)
  || repeat('ㅜ', CASE WHEN v + 1 >= 3 THEN 2 ELSE v + 1 END)
  || ' 아' || repeat('ㅋ', CASE WHEN k + 1 >= 3 THEN 2 ELSE k + 1 END)
  || ' ' || repeat('ㅎ', CASE WHEN k + 1 >= 3 THEN 2 ELSE k + 1 END) || 'ㅏ! '
  || repeat('ㅋ', CASE WHEN k >= 3 THEN 2 ELSE k END) || '가' || repeat('ㅠ', CASE WHEN v >= 3 THEN 2 ELSE v END) AS text
FROM n
""")
def emoticons(spark, sf):
    """Syllables typed into runs of jamo yield to them: by lead and vowel, by tail, by lead alone.
    One that fits neither neighbour stays.
    """
    k, v = F.length("text") % 4 + 1, F.length("text") % 3 + 1
    typed = F.concat(
        F.col("lang"), F.lit(" "), F.repeat(F.lit("ㅋ"), k), F.lit("쿠"), F.repeat(F.lit("ㅜ"), v),
        F.lit(" 앜"), F.repeat(F.lit("ㅋ"), k), F.lit(" "), F.repeat(F.lit("ㅎ"), k), F.lit("하! "),
        F.repeat(F.lit("ㅋ"), k), F.lit("가"), F.repeat(F.lit("ㅠ"), v))
    return documents(spark, sf).select("doc_id", T.normalize_emoticons(typed).alias("text"))

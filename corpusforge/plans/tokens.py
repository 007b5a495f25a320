"""Queries about tokens, blocks and examples.

Where only the shape of an example matters, the id of a word is its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions import tokens as K
from corpusforge.functions.stemming import stem_tokens
from corpusforge.functions.text import NUMBERED_MARKS, name_speakers
from corpusforge.operators import examples as E
from corpusforge.operators import lengths as L
from corpusforge.operators import packing as P
from corpusforge.operators import spans as N
from corpusforge.operators import bpe_training as B
from corpusforge.operators import vocabulary as V
from corpusforge.operators.dialog import assemble_documents, split_utterances
from corpusforge.operators.schema import has_supervision
from corpusforge.plans.dialogs import MARKED, TRANSCRIPTS, preferences, transcripts
from corpusforge.plans.registry import WS, documents, joined, query, table, words_sql
from corpusforge.values import BLOCK_SIZE, MIN_FREQUENCY, SPECIAL_TOKENS, VOCAB_SIZE

BLOCK = 128
BOS, EOS, PAD = 1, 2, 0
MAX = 64


def word_ids(text: Column) -> Column:
    return F.transform(K.words(text), lambda w: F.length(w))


def ids_sql(text: str) -> str:
    return f"list_transform({words_sql(text)}, lambda w: length(w))"


def joined_sql(array: str) -> str:
    return f"array_to_string({array}, ' ')"



def blocks_sql(rows: str, tokens: str, size: int, bos: str) -> str:
    """Blocks from ``rows`` (a query with source, doc_id, text)."""
    return f"""
d AS (SELECT source, doc_id, list_concat([{bos}], {tokens}) AS tok FROM ({rows})),
p AS (SELECT source, tok, CAST(coalesce(sum(len(tok)) OVER (PARTITION BY source ORDER BY doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
e AS (SELECT source, start + unnest(range(len(tok))) AS pos, unnest(tok) AS t FROM p)
SELECT source, pos // {size} AS block, string_agg(t, ' ' ORDER BY pos) AS input_ids
FROM e GROUP BY 1, 2 HAVING count(*) = {size}
"""


@query("WITH " + blocks_sql("SELECT * FROM documents WHERE length(text) >= 8",
                            words_sql("text"), BLOCK, "'<s>'"))
def packed_blocks(spark, sf):
    docs = documents(spark, sf).where(F.length("text") >= 8)
    tokens = docs.withColumn("ids", K.words(F.col("text")))
    blocks = P.pack_blocks(tokens, "source", ["doc_id"], "ids", BLOCK, "<s>")
    return blocks.withColumn("input_ids", joined("input_ids"))


@query("WITH " + blocks_sql("SELECT * FROM documents WHERE length(text) > 32",
                            ids_sql("text"), 1024, "1"))
def packed_long_texts(spark, sf):
    blocks = P.pack_long_texts(documents(spark, sf), "source", ["doc_id"], "text", word_ids,
                               1024, BOS)
    return blocks.withColumn("input_ids", joined("input_ids"))


@query(f"WITH {TRANSCRIPTS}, {MARKED}, " + blocks_sql(
    "SELECT 'dialogs-' || conv_id % 3 AS source, conv_id AS doc_id, text FROM marked",
    words_sql("text"), BLOCK, "'<s>'"))
def packed_dialogs(spark, sf):
    texts = transcripts(spark, sf).withColumn(
        "source", F.concat(F.lit("dialogs-"), F.col("conv_id") % 3))
    blocks = P.pack_dialogs(texts, "source", ["conv_id"], "text", K.words, "</s>", BLOCK, "<s>")
    return blocks.withColumn("input_ids", joined("input_ids"))


WORD_VOCAB = f"""
counted AS (
  SELECT piece, count(*) AS n FROM (SELECT unnest({words_sql("text")}) AS piece FROM documents)
  GROUP BY piece HAVING count(*) >= {MIN_FREQUENCY}),
vocab AS (
  SELECT row_number() OVER (ORDER BY n DESC, piece) + {len(SPECIAL_TOKENS) - 1} AS id, piece
  FROM counted QUALIFY row_number() OVER (ORDER BY n DESC, piece) <= {VOCAB_SIZE} - {len(SPECIAL_TOKENS)}
  UNION ALL
  SELECT unnest(range({len(SPECIAL_TOKENS)})), unnest({SPECIAL_TOKENS}))
"""


@query(f"WITH {WORD_VOCAB} SELECT CAST(id AS INT) AS id, piece FROM vocab")
def word_vocabulary(spark, sf):
    return V.word_vocab(documents(spark, sf))


@query(f"""WITH {WORD_VOCAB},
w AS (SELECT doc_id, unnest(tok) AS piece, unnest(range(len(tok))) AS pos
      FROM (SELECT doc_id, {words_sql("text")} AS tok FROM documents))
SELECT d.doc_id, coalesce(input_ids, '') AS input_ids, coalesce(decoded, '') AS decoded
FROM documents d LEFT JOIN (
  SELECT w.doc_id, string_agg(coalesce(v.id, 5), ' ' ORDER BY pos) AS input_ids,
         string_agg(coalesce(v.piece, '<unk>'), ' ' ORDER BY pos) AS decoded
  FROM w LEFT JOIN vocab v ON v.piece = w.piece GROUP BY w.doc_id) USING (doc_id)
""")
def encoded_words(spark, sf):
    docs = documents(spark, sf)
    vocab = V.word_vocab(docs)
    encode = V.word_encoder(vocab)
    ids = docs.select("doc_id", encode(K.words(F.col("text"))).alias("ids"))
    return ids.select(
        "doc_id", joined("ids").alias("input_ids"),
        V.decode_words(F.col("ids"), vocab).alias("decoded"))


ENCODED = """
encoded AS (
  SELECT source, doc_id, list(coalesce(v.id, 5) ORDER BY pos) AS ids
  FROM (SELECT source, doc_id, unnest(tok) AS piece, unnest(range(len(tok))) AS pos
        FROM (SELECT source, doc_id, """ + words_sql("text") + """ AS tok FROM documents
              WHERE length(text) > 32)) w
  LEFT JOIN vocab v ON v.piece = w.piece GROUP BY ALL)
"""


@query(f"WITH {WORD_VOCAB}, {ENCODED}, " + blocks_sql("SELECT * FROM encoded", "ids", BLOCK_SIZE, str(BOS)))
def packed_encoded_blocks(spark, sf):
    """Text to learned vocabulary to ids to blocks of 1,024 ids per source."""
    docs = documents(spark, sf)
    encode = V.word_encoder(V.word_vocab(docs))
    blocks = P.pack_long_texts(docs, "source", ["doc_id"], "text", lambda text: encode(K.words(text)),
                               BLOCK_SIZE, BOS)
    return blocks.withColumn("input_ids", joined("input_ids"))


@query(f"""WITH {WORD_VOCAB}
SELECT CAST(id AS INT) AS id, piece FROM vocab
UNION ALL SELECT CAST(m.id + i AS INT), name
FROM (SELECT max(id) AS id FROM vocab) m,
     (SELECT unnest(['<extra1>', '<extra2>']) AS name, unnest([1, 2]) AS i)
""")
def special_tokens_added(spark, sf):
    vocab = V.word_vocab(documents(spark, sf))
    return V.add_special(vocab, ["<usr>", "<extra1>", "<unused3>", "<extra2>", "<extra1>"])


# The SQL makes one merge per step, so it is given for the first merges only.
FIRST_MERGES = 16
BYTE_IDS = B.byte_ids(SPECIAL_TOKENS)
PRETOKENS_SQL = r"""list_filter(regexp_extract_all(
    regexp_replace(text, '(\s)(\s[^\s])', '\1' || chr(1) || '\2', 'g'),
    '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+'), lambda t: t <> '')"""


def merges_sql(merges: int) -> str:
    """One count of all pairs and one replacement for each merge."""
    first_id = len(SPECIAL_TOKENS) + 256
    steps = [f"""
t0 AS MATERIALIZED (
  SELECT '<' || array_to_string(list_transform(regexp_extract_all(hex(encode(token)), '..'),
         lambda h: {list(map(BYTE_IDS.get, range(256)))}[CAST('0x' || h AS INT) + 1]), '><') || '>' AS s, count(*) AS n
  FROM (SELECT unnest({PRETOKENS_SQL}) AS token FROM documents) GROUP BY token)"""]
    for i in range(merges):
        steps.append(f"""
p{i} AS MATERIALIZED (
  SELECT a, b, sum(n) AS n FROM (
    SELECT unnest(p[:-2]) AS a, unnest(p[2:]) AS b, n
    FROM (SELECT list_transform(string_split(s[2:-2], '><'), lambda x: CAST(x AS INT)) AS p, n FROM t{i}) WHERE len(p) > 1)
  GROUP BY a, b ORDER BY n DESC, a, b LIMIT 1),
t{i + 1} AS MATERIALIZED (
  SELECT replace(s, '<' || a || '><' || b || '>', '<{first_id + i}>') AS s, t.n FROM t{i} t, p{i})""")
    rows = " UNION ALL ".join(f"SELECT {i} AS rank, a, b FROM p{i}" for i in range(merges))
    return f"WITH {','.join(steps)} SELECT CAST(rank AS INT) AS rank, a, b FROM ({rows})"


@query(merges_sql(FIRST_MERGES))
def bpe_first_merges(spark, sf):
    """The pairs of piece ids that are merged first."""
    vocab, merges = B.train_bpe(documents(spark, sf), vocab_size=len(SPECIAL_TOKENS) + 256 + FIRST_MERGES)
    ids = [vocab.select(F.col("piece").alias(side), F.col("id").alias(name)) for side, name in (("left", "a"), ("right", "b"))]
    return merges.join(ids[0], "left").join(ids[1], "right").select("rank", "a", "b")


@query()
def bpe_merges(spark, sf):
    """A byte-level vocabulary of 51,200 pieces, or as many as the least frequency allows."""
    return B.train_bpe(documents(spark, sf))[1]


@query("SELECT doc_id, text AS decoded, true AS shorter FROM documents")
def bpe_round_trip(spark, sf):
    """Encoding and decoding gives the text back, in fewer ids than bytes."""
    docs = documents(spark, sf)
    vocab, merges = B.train_bpe(docs)
    ids = docs.select("doc_id", "text", V.bpe_encoder(vocab, merges)(F.col("text")).alias("ids"))
    return ids.select("doc_id", V.decode_bpe(F.col("ids"), vocab).alias("decoded"),
                      (F.size("ids") <= F.octet_length("text")).alias("shorter"))


@query(f"""
WITH n AS (SELECT len({words_sql("text")}) AS n FROM documents)
SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min,
       quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75,
       max(n) AS max
FROM n
""")
def length_profile(spark, sf):
    sizes = documents(spark, sf).select(F.size(K.words(F.col("text"))).alias("n"))
    return L.length_profile(sizes, "n").withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"""
WITH n AS (SELECT len({words_sql("text")}) AS n FROM documents),
s AS (SELECT min(n) AS low, max(n) - min(n) AS width FROM n),
c AS (SELECT least((n - low) * 20 // width, 19) AS bin, count(*) AS c FROM n, s GROUP BY 1),
b AS (SELECT unnest(range(20)) AS bin)
SELECT CAST(b.bin AS INT) AS bin, round(low + b.bin * width / 20, 6) AS begin,
       round(low + (b.bin + 1) * width / 20, 6) AS "end", coalesce(c, 0) AS count
FROM b CROSS JOIN s LEFT JOIN c ON b.bin = c.bin
""")
def length_histogram(spark, sf):
    sizes = documents(spark, sf).select(F.size(K.words(F.col("text"))).alias("n"))
    return L.length_histogram(sizes, "n").withColumns(
        {"begin": F.round("begin", 6), "end": F.round("end", 6)})


@query(f"""
SELECT doc_id, array_to_string(string_split_regex(lower(text), '{WS}'), '|') AS tokens
FROM documents
""")
def score_tokens(spark, sf):
    return documents(spark, sf).select(
        "doc_id", joined(K.score_tokens(F.col("text")), "|").alias("tokens"))


@query()
def stemmed_tokens(spark, sf):
    tokens = stem_tokens(K.score_tokens(F.col("text")))
    return documents(spark, sf).select("doc_id", joined(tokens, "|").alias("tokens"))


@query("""
SELECT doc_id, len(l) AS lines, array_to_string(l, '|') AS text FROM (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: s <> '') AS l FROM documents)
""")
def sentence_lines(spark, sf):
    lines = documents(spark, sf).select("doc_id", K.sentences(F.col("text")).alias("l"))
    return lines.select("doc_id", F.size("l").alias("lines"), joined("l", "|").alias("text"))


@query(rf"""
SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS place, unnest(l) AS sentence FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]){WS}', '\1' || chr(1), 'g'), chr(1)),
         lambda s: s <> '') AS l FROM documents)
""")
def sentence_split(spark, sf):
    pieces = K.sentences(F.col("text"), split_summaries=True)
    return documents(spark, sf).select("doc_id", F.posexplode(pieces).alias("place", "sentence"))


# Spans of hash-derived place and probability, three per document.
SPANS = """
spans AS (
  SELECT doc_id, h % length(text) AS s_begin, h % length(text) + (h // 7) % 90 AS s_end,
         (h // 11) % 100 / 100 AS prob
  FROM (SELECT doc_id, text, CAST('0x' || substr(md5(k || ':' || doc_id), 1, 7) AS BIGINT) AS h
        FROM documents, (SELECT unnest(['a', 'b', 'c']) AS k)))
"""


def span_rows(docs: DataFrame) -> DataFrame:
    keys = F.explode(F.array(*[F.lit(k) for k in "abc"])).alias("k")
    digest = F.md5(F.concat(F.col("k"), F.lit(":"), F.col("doc_id").cast("string")).cast("binary"))
    h = F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")
    rows = docs.select("doc_id", "text", keys).withColumn("h", h)
    begin = F.col("h") % F.nullif(F.length("text"), F.lit(0))  # an empty text has no place for a span
    return rows.select(
        "doc_id", begin.alias("begin"),
        (begin + F.floor(F.col("h") / 7) % 90).alias("end"),
        (F.floor(F.col("h") / 11) % 100 / 100).alias("prob"))


WORD_PLACES = f"""
places AS (
  SELECT doc_id, pos, b AS begin, b + length(w) AS w_end FROM (
    SELECT doc_id, pos, w, CAST(sum(length(w) + length(g)) OVER (PARTITION BY doc_id ORDER BY pos)
           - length(w) AS BIGINT) AS b
    FROM (SELECT doc_id, unnest(range(len(p))) AS pos,
                 unnest(list_transform(p, lambda x: regexp_replace(x, '^{WS}', ''))) AS w,
                 unnest(list_transform(p, lambda x: regexp_extract(x, '^{WS}'))) AS g
          FROM (SELECT doc_id, regexp_extract_all(text,
                  '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]*[^\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+') AS p
                FROM documents))))
"""


@query(f"""WITH {SPANS}, {WORD_PLACES}
SELECT p.doc_id, CAST(pos AS INT) AS pos,
       max(CASE WHEN s_begin IS NULL THEN 0 ELSE 1 END) AS label
FROM places p LEFT JOIN spans s ON s.doc_id = p.doc_id AND prob >= 0.5
     AND w_end >= s_begin AND s_end >= begin
GROUP BY p.doc_id, pos
""")
def span_labels(spark, sf):
    docs = documents(spark, sf)
    tokens = docs.select("doc_id", F.posexplode(N.word_offsets("text")).alias("pos", "t")).select(
        "doc_id", "pos", "t.begin", "t.end")
    return N.label_spans(tokens, span_rows(docs))


@query(f"""WITH {SPANS}, {WORD_PLACES}
SELECT doc_id, coalesce(string_agg(label, '' ORDER BY pos), '') AS labels FROM (
  SELECT d.doc_id, pos, CASE WHEN count(s_begin) > 0 THEN '1' WHEN pos IS NOT NULL THEN '0' END AS label
  FROM documents d LEFT JOIN places p ON p.doc_id = d.doc_id
  LEFT JOIN spans s ON s.doc_id = p.doc_id AND prob >= 0.5 AND w_end >= s_begin AND s_end >= begin
  GROUP BY d.doc_id, pos)
GROUP BY doc_id
""")
def span_labels_in_row(spark, sf):
    """Spans that come with their text, as a field of the row (three per document)."""
    docs = documents(spark, sf)
    spans = span_rows(docs).groupBy("doc_id").agg(
        F.collect_list(F.struct("begin", "end", "prob")).alias("spans"))
    tokens = docs.select("doc_id", N.word_offsets("text").alias("tokens"))
    labels = N.label_tokens(F.col("tokens"), F.col("spans"))
    labelled = tokens.join(spans, "doc_id").select("doc_id", labels.alias("labels"))
    return labelled.select("doc_id", joined("labels", "").alias("labels"))


@query(f"""
WITH t AS (SELECT doc_id, {ids_sql("'summary of ' || text")}[:{MAX}] AS p,
                  list_concat({ids_sql("source || ' in ' || lang")}, [{EOS}])[:{MAX}] AS a
           FROM documents),
c AS (SELECT doc_id, p[:{MAX} - len(a)] AS p, a FROM t)
SELECT doc_id, {joined_sql("list_concat(p, a)")} AS input_ids,
       {joined_sql("list_transform(list_concat(p, a), lambda x: 1)")} AS attention_mask,
       {joined_sql("list_concat(list_transform(p, lambda x: -100), a)")} AS labels
FROM c
""")
def prompt_examples(spark, sf):
    docs = documents(spark, sf).select(
        "doc_id", word_ids(F.concat(F.lit("summary of "), "text")).alias("prompt"),
        word_ids(F.concat_ws(" ", "source", F.lit("in"), "lang")).alias("answer"))
    rows = E.mask_prompt(docs, MAX, eos=EOS)
    return rows.select("doc_id", *[joined(c).alias(c)
                                   for c in ("input_ids", "attention_mask", "labels")])


def turns_sql(line: str) -> str:
    """Masked examples of whole conversations from the text of each turn."""
    return f"""
WITH u AS (
  SELECT conv_id, turn, role = 'assistant' AS bot, {ids_sql(line)}[:{MAX}] AS ids
  FROM conversations),
v AS (SELECT conv_id, turn, CASE WHEN bot THEN list_concat(ids, [{EOS}]) ELSE ids END AS ids,
             CASE WHEN bot THEN list_concat(ids, [{EOS}])
             ELSE list_transform(ids, lambda x: -100) END AS labels FROM u),
w AS (SELECT conv_id, flatten(list(ids ORDER BY turn))[:{MAX}] AS ids,
             flatten(list(labels ORDER BY turn))[:{MAX}] AS labels FROM v GROUP BY conv_id)
SELECT conv_id, {joined_sql("ids")} AS input_ids,
       {joined_sql("list_transform(ids, lambda x: 1)")} AS attention_mask,
       {joined_sql("labels")} AS labels
FROM w WHERE len(list_filter(labels, lambda x: x <> -100)) > 0
"""


def masked_turns(texts: DataFrame, marks: list[str], rewrite=lambda utterance: utterance) -> DataFrame:
    """Examples from whole conversations (conv_id, text) cut at ``marks``."""
    parts = texts.select("conv_id", F.transform(
        split_utterances(F.col("text"), marks), rewrite).alias("utterances"))
    ids = parts.withColumn("ids", F.transform("utterances", word_ids))
    rows = has_supervision(E.mask_turns(ids, "utterances", "ids", "<bot>", MAX, EOS))
    return rows.select("conv_id", *[joined(c).alias(c)
                                    for c in ("input_ids", "attention_mask", "labels")])


@query(turns_sql("CASE role WHEN 'user' THEN '<usr>' WHEN 'assistant' THEN '<bot>' ELSE '<sys>' END || ' ' || text"))
def turn_examples(spark, sf):
    mark = F.when(F.col("role") == "user", "<usr>").when(
        F.col("role") == "assistant", "<bot>").otherwise("<sys>")
    lines = table(spark, sf, "conversations").withColumn("line", F.concat(mark, F.lit(" "), "text"))
    texts = assemble_documents(lines, "conv_id", "turn", "line")
    return masked_turns(texts, ["<usr>", "<bot>", "<sys>"])


@query(turns_sql("CASE role WHEN 'assistant' THEN '<bot> ' ELSE '<usr> ' END || text"))
def numbered_turn_examples(spark, sf):
    """The same from transcripts with numbered marks, which become the tokens of the speakers."""
    number = F.when(F.col("role") == "assistant", "1 : ").otherwise("0 : ")
    lines = table(spark, sf, "conversations").withColumn("line", F.concat(number, "text"))
    texts = assemble_documents(lines, "conv_id", "turn", "line")
    return masked_turns(texts, list(NUMBERED_MARKS), name_speakers)


@query(f"""
SELECT doc_id, {joined_sql("ids")} AS input_ids,
       {joined_sql("list_transform(ids, lambda x: 1)")} AS attention_mask, {joined_sql("ids")} AS labels
FROM (SELECT doc_id, {ids_sql("text")}[:{MAX}] AS ids FROM documents)
""")
def causal_examples(spark, sf):
    docs = documents(spark, sf).withColumn("ids", word_ids(F.col("text")))
    rows = E.causal_example(docs, "ids", MAX)
    return rows.select("doc_id", *[joined(c).alias(c)
                                   for c in ("input_ids", "attention_mask", "labels")])


@query(f"""
SELECT doc_id, {joined_sql("ids")} AS input_ids,
       {joined_sql("list_transform(ids, lambda x: 1)")} AS attention_mask, quality AS class_labels
FROM (SELECT doc_id, quality, {ids_sql("text")}[:{MAX}] AS ids
      FROM documents JOIN labels USING (doc_id))
""")
def classification_examples(spark, sf):
    docs = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    rows = E.classification_example(docs.withColumn("ids", word_ids(F.col("text"))), "ids",
                                    "quality", MAX, "class_labels")
    return rows.select("doc_id", joined("input_ids").alias("input_ids"),
                       joined("attention_mask").alias("attention_mask"), "class_labels")


def pad_sql(array: str, length: str, value: int, left: bool = False) -> str:
    filler = f"list_transform(range(greatest({length} - len({array}), 0)), lambda x: {value})"
    return f"list_concat({filler}, {array})" if left else f"list_concat({array}, {filler})"


@query(f"""
WITH t AS (SELECT doc_id, {ids_sql("text")}[:60] AS ids FROM documents)
SELECT doc_id, {joined_sql(pad_sql("ids", "64", PAD))} AS input_ids,
       {joined_sql(pad_sql("list_transform(ids, lambda x: 1)", "64", 0))} AS attention_mask,
       {joined_sql(pad_sql("ids", "64", -100))} AS labels
FROM t
""")
def padded_examples(spark, sf):
    docs = documents(spark, sf).withColumn("ids", word_ids(F.col("text")))
    rows = E.pad_examples(E.causal_example(docs, "ids", 60), 60, 8, "right", PAD)
    return rows.select("doc_id", *[joined(c).alias(c)
                                   for c in ("input_ids", "attention_mask", "labels")])


@query(f"""
WITH t AS (SELECT doc_id, doc_id // 4 AS batch, {ids_sql("text")}[:60] AS ids FROM documents),
m AS (SELECT *, (max(len(ids)) OVER (PARTITION BY batch) + 7) // 8 * 8 AS n FROM t)
SELECT doc_id, {joined_sql(pad_sql("ids", "n", PAD, True))} AS input_ids,
       {joined_sql(pad_sql("list_transform(ids, lambda x: 1)", "n", 0, True))} AS attention_mask,
       {joined_sql(pad_sql("ids", "n", -100, True))} AS labels
FROM m
""")
def padded_batches(spark, sf):
    """Left padding to the longest row of batches of four documents."""
    docs = documents(spark, sf).withColumn("ids", word_ids(F.col("text"))).withColumn(
        "batch", F.floor(F.col("doc_id") / 4))
    rows = E.pad_examples(E.causal_example(docs, "ids", 60), None, 8, "left", PAD, ["batch"])
    return rows.select("doc_id", *[joined(c).alias(c)
                                   for c in ("input_ids", "attention_mask", "labels")])


PAIR_TEXTS = """
p AS (SELECT a.conv_id, a.turn, b.text AS prompt, a.text AS chosen,
             coalesce(d.text, ' ' || chr(10)) AS rejected
      FROM conversations a
      JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
      LEFT JOIN conversations d ON d.conv_id = a.conv_id + 1 AND d.turn = a.turn
      WHERE a.role = 'assistant')
"""


def pair_rows(spark, sf) -> DataFrame:
    rows = preferences(spark, sf)
    return rows.select("conv_id", "turn", F.col("instruction.value").alias("prompt"),
                       F.col("chosen.value").alias("chosen"),
                       F.col("rejected.value").alias("rejected"))


def encoded(ids: Column, prefix: str = "") -> list[Column]:
    return [ids.alias(f"{prefix}input_ids"), K.ones(ids).alias(f"{prefix}attention_mask")]


@query(f"""
WITH {PAIR_TEXTS},
i AS (SELECT conv_id, turn, {ids_sql("prompt || ' ' || chosen")}[-60:] AS c,
             {ids_sql("prompt || ' ' || rejected")}[-60:] AS r FROM p)
SELECT conv_id, turn, {joined_sql(pad_sql("c", "64", PAD))} AS chosen_ids,
       {joined_sql(pad_sql("list_transform(c, lambda x: 1)", "64", 0))} AS chosen_mask,
       {joined_sql(pad_sql("r", "64", PAD))} AS rejected_ids,
       {joined_sql(pad_sql("list_transform(r, lambda x: 1)", "64", 0))} AS rejected_mask
FROM i
""")
def padded_pairs(spark, sf):
    def side(name: str) -> Column:
        ids = K.truncate(word_ids(F.concat_ws(" ", "prompt", name)), 60, "left")
        return F.struct(*encoded(ids)).alias(name)

    rows = E.pad_pairs(pair_rows(spark, sf).select("conv_id", "turn", side("chosen"),
                                                   side("rejected")), 60, 8, "right", PAD)
    return rows.select("conv_id", "turn", *[
        joined(f"{s}.{c}").alias(f"{s}_{o}") for s in ("chosen", "rejected")
        for c, o in (("input_ids", "ids"), ("attention_mask", "mask"))])


@query(f"""
WITH {PAIR_TEXTS},
i AS (SELECT conv_id, turn, {ids_sql("prompt")}[-40:] AS e, {ids_sql("chosen")}[:20] AS c,
             {ids_sql("rejected")}[:20] AS r FROM p)
SELECT conv_id, turn, {joined_sql(pad_sql("e", "40", PAD))} AS prompt_ids,
       {joined_sql(pad_sql("c", "24", PAD))} AS chosen_ids,
       {joined_sql(pad_sql("list_transform(c, lambda x: 1)", "24", 0))} AS chosen_mask,
       {joined_sql(pad_sql("r", "24", PAD))} AS rejected_ids
FROM i
""")
def padded_seq2seq(spark, sf):
    def side(name: str) -> Column:
        prompt = K.truncate(word_ids(F.col("prompt")), 40, "left")
        answer = K.truncate(word_ids(F.col(name)), 20)
        return F.struct(*encoded(prompt), *encoded(answer, "decoder_")).alias(name)

    rows = E.pad_seq2seq(pair_rows(spark, sf).select("conv_id", "turn", side("chosen"),
                                                     side("rejected")), 40, 20, 8, "right", PAD)
    return rows.select(
        "conv_id", "turn", joined("chosen.input_ids").alias("prompt_ids"),
        joined("chosen.decoder_input_ids").alias("chosen_ids"),
        joined("chosen.decoder_attention_mask").alias("chosen_mask"),
        joined("rejected.decoder_input_ids").alias("rejected_ids"))

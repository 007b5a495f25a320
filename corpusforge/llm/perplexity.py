"""Quality rules: counts of words, symbols and repeats, and perplexity within bands.

The language model is a modified Kneser-Ney model over runs of five characters, one for each
language, of the texts that pass the base rules. Case, punctuation, digits and script count:
a character is a symbol of its own, and only those above 4,095 share symbols. Spark counts the
runs and computes probabilities and back-off weights as tables that grow with the corpus; runs
that only one document holds give their mass to shorter ones, so no text vouches for itself.

To score, the tables become arrays sorted by the hash of the run. Up to ``MODEL_ROWS`` rows
they are broadcast at once. A larger model is cut by the hash of the context into shards of
that size, and the texts are read once for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm.common import (
    by_slices, free_name, mix64, query, saved, segment_sums, slices, small_batches, stored_rows, table, utf8,
)

ORDER = 5
BITS = 12
SYMBOLS_KNOWN = 1 << BITS
MODEL_ROWS = 1 << 22
HELD = 1 << 21  # runs that a counting task holds before it passes them on
FRESH = 1 << 18  # runs of single texts that wait, at least, before they are added to those
PASSED = 1 << 16  # runs passed on in one batch, which stands in the executor's memory as well
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs that end at each character of each text, and where each text starts and ends.

    A text is read after four blanks that are no character, so its first characters have a
    context as well. All white space is one symbol.
    """
    lead = "\0" * (ORDER - 1)
    parts = [lead + t.decode(errors="replace") for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    symbols = np.where(points < SYMBOLS_KNOWN, points, SYMBOLS_KNOWN // 2 + points * 40503 % (SYMBOLS_KNOWN // 2))
    symbols[(points >= 9) & (points <= 13)] = 32
    if not len(symbols):
        return np.zeros(0, np.int64), starts, starts
    codes = symbols[: len(symbols) - ORDER + 1].copy()
    for k in range(1, ORDER):
        codes <<= BITS
        codes |= symbols[k : len(symbols) - ORDER + 1 + k]
    return codes, starts, starts + sizes - (ORDER - 1)


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct keys of the parts with the sums of their counts."""
    key, *counts = (np.concatenate(column) for column in zip(*parts))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(c[order], first) if len(key) else c for c in counts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Columns lang, text.
    held: dict[str | None, tuple[np.ndarray, ...]] = {}
    fresh: dict[str | None, list[tuple[np.ndarray, ...]]] = {}

    def add() -> int:
        for lang, parts in fresh.items():
            held[lang] = summed([held[lang], *parts] if lang in held else parts)
        fresh.clear()
        return sum(len(grams) for grams, *_ in held.values())

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, columns in held.items():
            for at in range(0, len(columns[0]), PASSED):
                grams, n, texts = (pa.array(c[at : at + PASSED]) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang, pa.string()), len(grams)), grams, n, texts], ["lang", "gram", "n", "texts"])
        held.clear()

    waiting = size = 0
    for batch in slices(batches, 256):
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            if not base_failed(text.split()):
                grams, n = np.unique(grams_of([text])[0], return_counts=True)
                fresh.setdefault(lang, []).append((grams, n, np.ones(len(grams), np.int64)))
                waiting += len(grams)
        if waiting > min(HELD, max(FRESH, size)):  # as many wait as are held: each is sorted a few times
            waiting, size = 0, add()
            if size > HELD:
                yield from passed_on()
                size = 0
    add()
    yield from passed_on()


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n, texts): occurrences, and texts that hold it, over all texts that pass the
    base rules; each task sums its own before anything is shuffled.
    """
    small_batches(docs.sparkSession)
    counted = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(
        _count, "lang string, gram long, n long, texts long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts from the numbers of runs counted once to
    four times; where those are missing, halves.
    """
    numbers = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.expr("try_divide(n1, n1 + 2 * n2)")
    parts = {f"d{k}": (k, y * (k + 1) * F.expr(f"try_divide(n{k + 1}, n{k})")) for k in (1, 2, 3)}
    return counts.groupBy("lang").agg(*numbers).select("lang", *[
        F.greatest(F.lit(0.1 * k), F.least(F.lit(0.9 * k), F.coalesce(k - share, F.lit(0.5 * k)))).alias(name)
        for name, (k, share) in parts.items()])


def model_tables(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney as rows (lang, weight, order, gram, log): the logarithm of the
    probability of a run after its context, or (``weight``) of the back-off weight of a context.

    Below the highest order a run counts the different symbols before it. Runs of one document
    count towards the total of their context but have no probability of their own.
    """
    def context(gram: str = "gram") -> Column:
        return F.shiftright(gram, BITS).alias("context")

    grams = counts.where("texts > 1").select("lang", "gram", "n")
    totals = counts.groupBy("lang", context()).agg(F.sum("n").alias("total"))
    levels = [(grams, totals, discounts(counts))]
    for order in range(ORDER - 1, 0, -1):
        grams = saved(grams.groupBy("lang", F.col("gram").bitwiseAND((1 << order * BITS) - 1).alias("gram")).agg(F.count("*").alias("n")))
        levels.append((grams, grams.groupBy("lang", context()).agg(F.sum("n").alias("total")), discounts(grams)))
    rows, lower = [], None
    for order, (grams, totals, discount) in zip(range(1, ORDER + 1), reversed(levels)):
        taken = F.col("n") - F.expr("CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END")
        reduced = grams.withColumn("context", context()).join(discount, "lang").withColumn("reduced", taken)
        contexts = saved(reduced.groupBy("lang", "context").agg(F.sum("reduced").alias("held")).join(totals, ["lang", "context"]).select(
            "lang", "context", "total", F.greatest(1 - F.col("held") / F.col("total"), F.lit(1e-9)).alias("weight")))
        found = reduced.join(contexts, ["lang", "context"])
        if lower is None:
            found = found.withColumn("shorter", F.lit(1.0 / SYMBOLS_KNOWN))
        else:
            suffix = F.col("gram").bitwiseAND((1 << (order - 1) * BITS) - 1)
            found = found.withColumn("suffix", suffix).join(
                lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("shorter")), ["lang", "suffix"])
        lower = saved(found.select("lang", "gram", (F.col("reduced") / F.col("total") + F.col("weight") * F.col("shorter")).alias("p")))
        rows.append(lower.select("lang", F.lit(False).alias("weight"), F.lit(order).alias("order"), "gram", F.log("p").alias("log")))
        rows.append(contexts.select("lang", F.lit(True).alias("weight"), F.lit(order - 1).alias("order"), F.col("context").alias("gram"),
                                    F.log("weight").alias("log")))
    return reduce(DataFrame.unionByName, rows)  # of stored tables


class Arrays:
    """One shard of the model of one language: keys sorted by hash, with their logarithms."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        keys = mix64(keys.view(np.uint64))
        by_key = np.argsort(keys)
        self.keys, self.logs = keys[by_key], logs[by_key]

    def find(self, weight: bool, order: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms, and which of the runs are there."""
        keys = mix64(grams.astype(np.uint64) | np.uint64((order << 60) | (weight << 63)))
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        found = self.keys[at] == keys if len(self.keys) else np.zeros(len(grams), bool)
        return (self.logs[at] if len(self.keys) else np.zeros(len(grams), np.float32)), found

    def score(self, grams: np.ndarray) -> np.ndarray:
        """ln P(last symbol | the others): the longest known run, with back-off weights."""
        total, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            known = grams[open_] & ((1 << (order * BITS)) - 1)
            log, found = self.find(False, order, known)
            total[open_[found]] += log[found]
            open_, known = open_[~found], known[~found]
            weight, seen = self.find(True, order - 1, known >> BITS)
            total[open_[seen]] += weight[seen]
        total[open_] -= BITS * np.log(2)
        return total


def shard_of(pair: np.ndarray | Column, shards: int):
    """The shard of the two symbols before the last of a run."""
    return pair * 40503 % 65521 % shards


def number_of(lang: str | None) -> int:
    """A number for each language, the same as ``shards_of`` gives it in Spark."""
    return zlib.crc32(b"" if lang is None else b"=" + lang.encode()) - (1 << 31)


def shards_of(model: DataFrame) -> Iterator[tuple[int, int, dict[int, Arrays]]]:
    """The model in arrays by language, in shards of about MODEL_ROWS rows, brought to the driver
    one by one: 16 bytes a row.

    A run and the contexts it backs off to have the two symbols before its last in common, so
    they share a shard; runs of one or two symbols, and their contexts, are in every one.
    """
    shards = max(1, -(-model.count() // MODEL_ROWS))
    pair = F.when(F.col("weight"), F.col("gram")).otherwise(F.shiftright("gram", BITS)).bitwiseAND((1 << 2 * BITS) - 1)
    short = F.col("order") + F.col("weight").cast("int") < 3
    name = F.crc32(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).cast("binary")) - (1 << 31)
    key = F.col("gram").bitwiseOR(F.shiftleft(F.col("order").cast("long"), 60)).bitwiseOR(
        F.when(F.col("weight"), F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long")))
    compact = [name.cast("int").alias("lang"), key.alias("key"), F.col("log").cast("float").alias("log")]
    for shard in range(shards):
        mine = model.where(short | (shard_of(pair, shards) == shard)) if shards > 1 else model
        rows = mine.select(*compact).toArrow()
        lang, keys, logs = (rows.column(c).to_numpy() for c in ("lang", "key", "log"))
        del rows
        found = {}
        for number in np.unique(lang).tolist():
            own = lang == number
            found[number] = Arrays(keys[own], logs[own])
        del lang, keys, logs
        pa.default_memory_pool().release_unused()
        yield shard, shards, found


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = hashes[:n].copy()
    for k in range(1, WINDOW):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += hashes[k : n + k]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    places: dict[tuple, list[int]] = {}  # equal hashes are only a hint
    for at in np.flatnonzero(np.isin(rolled, twice)).tolist():
        places.setdefault(tuple(words[at : at + WINDOW]), []).append(at)
    inside = np.zeros(len(words) + 1, np.int64)
    for found in places.values():
        if len(found) > 1:
            np.add.at(inside, found, 1)
            np.add.at(inside, np.array(found) + WINDOW, -1)
    return int((np.cumsum(inside) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    lines = [line for line in lines if line.strip()]
    return len(lines) - len(set(lines))


METRICS = T.StructType([
    T.StructField(name, T.LongType())
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
] + [T.StructField("base_failed", T.BooleanType()), T.StructField("n_scored", T.LongType())])
KINDS = {"long": pa.int64(), "boolean": pa.bool_()}


def base_failed(words: list[bytes]) -> bool:
    return len(words) < MIN_WORDS or 100 * repeated_words(words) > MAX_REPEAT_PERCENT * len(words)


def measure(texts: list[bytes]) -> list[dict]:
    """Base counts of texts; ``n_scored`` is the number of characters."""
    rows = []
    for text in texts:
        words = text.split()
        solid = text.translate(None, SPACE)
        repeat = repeated_words(words)
        rows.append({
            "n_words": len(words), "word_chars": len(solid.decode()),
            "n_symbols": len(solid) - len(solid.translate(None, SYMBOLS)),
            "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeat,
            "base_failed": len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words),
            "n_scored": len(text.decode()),
        })
    return rows


@F.arrow_udf(METRICS)
def base_metrics(text: pa.Array) -> pa.Array:
    kind = pa.struct([(f.name, KINDS[f.dataType.typeName()]) for f in METRICS])
    return by_slices(lambda texts: pa.array(measure(utf8(texts)), kind), text)


def log_sum(sent: Broadcast, shard: int, shards: int):
    """Function from language and text to the sum of the scores of its runs in a shard."""
    def total(langs: pa.Array, texts: pa.Array) -> pa.Array:
        arrays = sent.value
        codes, starts, ends = grams_of(utf8(texts))
        names = langs.to_pylist()
        sums = np.zeros(len(names))
        for lang in set(names):
            mine = [i for i, name in enumerate(names) if name == lang]
            parts = [codes[starts[i] : ends[i]] for i in mine]
            whole, at = np.unique(np.concatenate(parts), return_inverse=True)
            model = arrays.get(number_of(lang))
            score = model.score(whole) if model else np.full(len(whole), -BITS * np.log(2))
            if shards > 1:
                score[shard_of((whole >> BITS) & ((1 << 2 * BITS) - 1), shards) != shard] = 0
            stops = np.cumsum([len(p) for p in parts])
            sums[mine] = segment_sums(score[at], np.concatenate([[0], stops[:-1]]).astype(np.int64), stops)
        return pa.array(sums)

    def scored(langs: pa.Array, texts: pa.Array) -> pa.Array:
        return by_slices(total, langs, texts, rows=256)

    scored.__annotations__ = {"langs": pa.Array, "texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scored, T.DoubleType())


def measured(docs: DataFrame, model: DataFrame, text: str = "text", lang: str = "lang", out: str = "metrics") -> DataFrame:
    """Add ``out``: a struct of counts, ``base_failed``, ``n_scored`` and ``log_perplexity``.

    Null counts as the empty text: no words, base_failed, no perplexity. Texts whose language is
    null have a model of their own. Other columns stay; one that is already called ``out`` is
    replaced. A model of several shards takes a reading of the texts for each; the sums, one
    number a row, are then joined by row.
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    docs, row, total = stored_rows(docs), free_name(docs, "row"), free_name(docs, "total")
    name = F.col(lang).cast("string")
    sums = []
    for shard, shards, arrays in shards_of(model):
        score = log_sum(context.broadcast(arrays), shard, shards)(name, F.col(text))
        if shards == 1:
            found = docs.withColumn(total, score)
            break
        sums.append(saved(docs.select(F.monotonically_increasing_id().alias(row), score.alias(total))))
    else:
        summed_ = reduce(DataFrame.unionByName, sums).groupBy(row).agg(F.sum(total).alias(total))
        found = docs.withColumn(row, F.monotonically_increasing_id()).join(summed_, row).drop(row)
    base = base_metrics(F.col(text))
    return found.withColumn(out, base).withColumn(out, F.col(out).withField(
        "log_perplexity", F.when(F.col(f"{out}.n_scored") > 0, -F.col(total) / F.col(f"{out}.n_scored")))).drop(total)


BUCKET = 1 / 512
SPREADS = 4.0
SHORT_TEXT = 1.0
FEW_TEXTS = 30.0


def perplexity_bands(found: DataFrame, lang: str = "lang", metrics: str = "metrics") -> DataFrame:
    """(band, middle, spread, texts): median and quartile distance of the log perplexity, and the
    number of texts they come from, for each language, null among them.

    Exact quantiles of values rounded to ``BUCKET``, over all texts that pass the base rules.
    """
    value = F.col(f"{metrics}.log_perplexity")
    passed = found.where(~F.col(f"{metrics}.base_failed") & value.isNotNull())
    counts = saved(passed.groupBy(
        F.col(lang).cast("string").alias("band"), F.round(value / BUCKET).cast("long").alias("at")).agg(F.count("*").alias("n")))
    # Buckets of one language: some thousands at most, whatever the number of its texts.
    ranked = counts.withColumns({
        "upto": F.sum("n").over(Window.partitionBy("band").orderBy("at")),
        "size": F.sum("n").over(Window.partitionBy("band"))})

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("size") * q, F.col("at"))) * BUCKET

    return ranked.groupBy("band").agg(
        quantile(0.5).alias("middle"), (quantile(0.75) - quantile(0.25)).alias("spread"), F.sum("n").alias("texts"))


def judged(found: DataFrame, bands: DataFrame, lang: str = "lang", metrics: str = "metrics",
           out: str = "kept") -> DataFrame:
    """Add ``out``: false for texts that fail the base rules or lie outside the band of their language.

    The band is ``middle`` plus or minus ``SPREADS`` quartile distances and a margin that falls
    with the square root of the length: the mean of few symbols varies more. Quartiles of few
    texts are not certain, so the band is wider by the factor 1 + FEW_TEXTS / texts; there is
    no number of texts at which another rule sets in.
    """
    band, middle, spread, texts = (free_name(found, n) for n in ("band", "middle", "spread", "texts"))
    own = bands.select("band", "middle", "spread", "texts").toDF(band, middle, spread, texts)
    value, n = F.col(f"{metrics}.log_perplexity"), F.col(f"{metrics}.n_scored")
    width = (F.col(spread) * SPREADS + SHORT_TEXT / F.sqrt(n)) * (1 + FEW_TEXTS / F.col(texts))
    return (
        found.join(own, F.col(lang).cast("string").eqNullSafe(F.col(band)), "left")
        .withColumn(out, F.coalesce(
            ~F.col(f"{metrics}.base_failed") & (F.abs(value - F.col(middle)) <= width), F.lit(False)))
        .drop(band, middle, spread, texts)
    )


def train_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The model of all texts that pass the base rules, as the table of ``model_tables``."""
    return model_tables(saved(count_grams(docs, text, lang)))


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass; all columns and repeated rows stay, an empty table stays empty.

    Texts are read twice, to count and to score. They are stored with their metrics, so that
    the bands and the verdict score nothing again.
    """
    metrics, kept = free_name(docs, "metrics"), free_name(docs, "kept")
    found = saved(measured(docs, train_model(docs, text, lang), text, lang, metrics))
    bands = saved(perplexity_bands(found, lang, metrics))
    return judged(found, bands, lang, metrics, kept).where(kept).select(*docs.columns)


@query("op3_perplexity")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = saved(measured(docs, train_model(docs)).select("doc_id", "lang", "metrics"))
    return judged(found, saved(perplexity_bands(found))).select(
        "doc_id", *[f"metrics.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                             "n_repeat_words", "base_failed")],
        "kept", "metrics.log_perplexity")

"""ROUGE: overlap of a prediction with a target."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions.batches import by_slices
from corpusforge.functions.stemming import stemmed
from corpusforge.functions.tokens import ngrams, score_tokens, sentences

Tokenizer = Callable[[Column], Column]
NGRAM_TYPE = re.compile(r"rouge([1-9])$")
PARTS = ("precision", "recall", "fmeasure")


def check_types(types: Sequence[str]) -> None:
    unknown = [t for t in types if t not in ("rougeL", "rougeLsum") and not NGRAM_TYPE.match(t)]
    if unknown:
        raise ValueError(f"unknown overlap types: {', '.join(unknown)}")


def _score(hits: Column, target: Column, prediction: Column) -> Column:
    """Precision, recall and F measure of counts; 0 where a side is empty."""
    p = hits / F.greatest(prediction, F.lit(1))
    r = hits / F.greatest(target, F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("fmeasure"))


def ngram_counts(df: DataFrame, key: Sequence[str], tokens: str, n: int) -> DataFrame:
    """The n-gram multiset of each row: ``key, ngram, count``."""
    grams = F.transform(ngrams(F.col(tokens), n), lambda g: F.array_join(g, " "))
    return df.select(*key, F.explode(grams).alias("ngram")).groupBy(*key, "ngram").agg(
        F.count("*").alias("count"))


def ngram_hits(tokens: np.ndarray, targets: np.ndarray, predictions: np.ndarray, n: int) -> np.ndarray:
    """Per pair, its common n-grams, each as often as on the side that has fewer, and both totals.

    ``tokens`` are the numbers of the tokens of all targets, then of all predictions, whose
    sizes follow. An n-gram gets a number from that of the n-gram a token shorter.
    """
    pairs, sizes = len(targets), np.concatenate([targets, predictions])
    side, left = np.repeat(np.arange(2 * pairs), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(tokens))
    grams, kinds = tokens, int(tokens.max(initial=0)) + 1
    for k in range(1, n):
        grams = np.unique(grams[: max(len(tokens) - k, 0)] * kinds + tokens[k:], return_inverse=True)[1]
    begins = left[: len(grams)] >= n
    grams, side = grams[begins], side[: len(begins)][begins]
    kinds, first = int(grams.max(initial=0)) + 1, np.searchsorted(side, pairs)
    keys = side % max(pairs, 1) * kinds + grams
    wanted, often = np.unique(keys[:first], return_counts=True)
    hits = np.zeros(pairs, np.int64)
    if len(wanted):
        at = np.minimum(np.searchsorted(wanted, keys[first:]), len(wanted) - 1)
        met = np.bincount(at[wanted[at] == keys[first:]], minlength=len(wanted))
        np.add.at(hits, wanted // kinds, np.minimum(often, met))
    return np.stack([hits, np.maximum(targets - n + 1, 0), np.maximum(predictions - n + 1, 0)])


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a bit per element of the shorter side.

    Bit-vector recurrence of Hyyrö (2004): zero bits mark where the length grows.
    """
    if len(a) > len(b):
        a, b = b, a
    places: dict = defaultdict(int)
    for i, token in enumerate(a):
        places[token] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        if token in places:
            match = row & places[token]
            row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def lcs_positions(ref: Sequence, can: Sequence) -> list[int]:
    """Positions in ``ref`` of one longest common subsequence.

    Walks back from the ends; where the lengths to the left and above tie, the
    walk goes to the element before in ``ref``.
    """
    places: dict = defaultdict(int)
    for j, token in enumerate(can):
        places[token] |= 1 << j
    full = (1 << len(can)) - 1
    rows = [full]
    for token in ref:
        row = rows[-1]
        match = row & places[token] if token in places else 0
        rows.append(((row + match) | (row - match)) & full)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    found: list[int] = []
    i, j = len(ref), len(can)
    whole = length(i, j)
    while len(found) < whole:  # what is left of the way holds no common token
        if ref[i - 1] == can[j - 1]:
            i, j = i - 1, j - 1
            found.append(i)
        elif rows[i] >> (j - 1) & 1 and length(i, j) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return found[::-1]


def summary_hits(ref: Sequence[Sequence], can: Sequence[Sequence]) -> int:
    """Tokens of the reference sentences in a common subsequence with any candidate sentence.

    A token counts at most as often as the candidate has it. Candidate sentences without
    a common token add nothing and are not looked at.
    """
    holders: dict = defaultdict(set)
    for k, sentence in enumerate(can):
        for token in sentence:
            holders[token].add(k)
    covered: Counter = Counter()
    for sentence in ref:
        related = {k for token in set(sentence) for k in holders.get(token, ())}
        places = {i for k in related for i in lcs_positions(sentence, can[k])}
        covered.update(sentence[i] for i in places)
    return (covered & Counter(token for sentence in can for token in sentence)).total()


def _numbered(*sides: pa.Array) -> np.ndarray:
    """A number for each token of the sides, the same for equal ones."""
    filled = [side for side in sides if len(side)]  # empty ones may lack the offsets they are joined by
    if not filled:
        return np.zeros(0, np.int64)
    tokens = pa.concat_arrays(filled).dictionary_encode(null_encoding="encode")
    return tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(values: list, sizes: np.ndarray) -> list[list]:
    ends = np.cumsum(sizes).tolist()
    return [values[end - size : end] for end, size in zip(ends, sizes.tolist())]


def counts_udf(types: Sequence[str], n_columns: int, stem: bool = False) -> Callable[..., Column]:
    """Hits, target total and prediction total of every type, one after the other.

    Columns: tokens of both sides and, for summaries, tokens of the sentences of both.
    """
    def measure(*columns: pa.Array) -> pa.Array:
        if stem:
            columns = tuple(map(stemmed, columns))
        t, p, *lines = columns
        tokens, sizes = _numbered(t.flatten(), p.flatten()), [_sizes(t), _sizes(p)]
        counts = []
        for name in types:
            if name == "rougeL":
                pairs = _cut(tokens.tolist(), np.concatenate(sizes))
                hits = [lcs_length(a, b) for a, b in zip(pairs[: len(t)], pairs[len(t) :])]
                counts += [np.array(hits, np.int64), *sizes]
            elif name == "rougeLsum":
                words = _numbered(*[c.flatten().flatten() for c in lines]).tolist()
                parts = _cut(words, np.concatenate([_sizes(c.flatten()) for c in lines]))
                texts = _cut(parts, np.concatenate([_sizes(c) for c in lines]))
                pairs = list(zip(texts[: len(t)], texts[len(t) :]))
                counts += [np.array([summary_hits(*pair) for pair in pairs], np.int64), *[
                    np.array([sum(map(len, pair[i])) for pair in pairs], np.int64) for i in (0, 1)]]
            else:
                counts += [*ngram_hits(tokens, *sizes, int(name[5:]))]
        table = np.stack(counts, axis=1)
        borders = np.arange(len(t) + 1, dtype=np.int32) * table.shape[1]
        return pa.ListArray.from_arrays(pa.array(borders), pa.array(table.reshape(-1)))

    def pair(t: pa.Array, p: pa.Array) -> pa.Array:
        return by_slices(measure, t, p)

    def pair_with_sentences(t: pa.Array, p: pa.Array, ts: pa.Array, ps: pa.Array) -> pa.Array:
        return by_slices(measure, t, p, ts, ps)

    counts = pair if n_columns == 2 else pair_with_sentences
    counts.__annotations__ = dict.fromkeys([*counts.__annotations__], pa.Array)
    return F.arrow_udf(counts, T.ArrayType(T.LongType()))


def rouge(df: DataFrame, types: Sequence[str], key: str | Sequence[str], target: str = "target",
          prediction: str = "prediction", tokenizer: Tokenizer = score_tokens,
          stem: bool = False, split_summaries: bool = False) -> DataFrame:
    """``key`` and one score struct per type, row by row: nothing is shuffled or joined.

    Types are ``rouge1`` to ``rouge9``, ``rougeL`` and ``rougeLsum``. Any function
    from a text column to a token array column can be the tokenizer.
    """
    check_types(types)
    key = [key] if isinstance(key, str) else list(key)

    def lines(column: str) -> Column:
        return F.transform(sentences(F.col(column), split_summaries), tokenizer)

    whole = any(t != "rougeLsum" for t in types)  # else only sentences are looked at
    columns = [tokenizer(F.col(c)) if whole else F.array().cast("array<string>") for c in (target, prediction)]
    if "rougeLsum" in types:
        columns += [lines(target), lines(prediction)]
    counted = df.select(*key, counts_udf(types, len(columns), stem)(*columns).alias("_counts"))
    return counted.select(*key, *[
        _score(*[F.col("_counts")[3 * i + k] for k in range(3)]).alias(t) for i, t in enumerate(types)])


def rouge_multi(df: DataFrame, types: Sequence[str], key: str, reference: str,
                target: str = "target", prediction: str = "prediction", **options) -> DataFrame:
    """Several references per key: for each type the score with the highest F measure.

    ``reference`` numbers the references; the first of equal scores wins. A
    maximum over ordered structs, so partial results combine before the shuffle.
    """
    scores = rouge(df, types, [key, reference], target, prediction, **options)
    best = [
        F.max(F.struct(F.col(t)["fmeasure"], -F.col(reference), F.col(t).alias("score")))["score"]
        .alias(t) for t in types
    ]
    return scores.groupBy(key).agg(*best)


def long_scores(scores: DataFrame, key: Sequence[str], types: Sequence[str]) -> DataFrame:
    """``key, score_type, precision, recall, fmeasure``, one row per type."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("score_type"), F.col(t).alias("s")) for t in types]))
    return scores.select(*key, rows.alias("r")).select(*key, "r.score_type", "r.s.*")


def mean_rouge(scores: DataFrame, types: Sequence[str], per_part: bool = True) -> DataFrame:
    """Mean scores per type; ``per_part=False`` averages all three parts together."""
    rows = long_scores(scores, [], types).groupBy("score_type")
    if per_part:
        return rows.agg(*[F.avg(p).alias(p) for p in PARTS])
    return rows.agg(F.avg((F.col("precision") + F.col("recall") + F.col("fmeasure")) / 3).alias(
        "mean"))


def align_records(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """Pair records by file rank and record number; a missing partner fails the job.

    Both sides come from ``sources.readers.read_records``.
    """
    t = targets.select("file", "record", F.col("text").alias("target"), F.lit(True).alias("_t"))
    p = predictions.select("file", "record", F.col("text").alias("prediction"),
                           F.lit(True).alias("_p"))
    both = t.join(p, ["file", "record"], "full_outer")
    lost = F.raise_error(F.concat(
        F.lit("a record without partner in file "), F.col("file"), F.lit(", place "), F.col("record")))
    whole = F.col("_t").isNotNull() & F.col("_p").isNotNull()
    return both.select(
        "file", "record",
        F.when(whole, F.col("target")).otherwise(lost.cast("string")).alias("target"),
        F.when(whole, F.col("prediction")).otherwise(lost.cast("string")).alias("prediction"))

"""Packing token sequences under several limits at once.

Examples are vectors: tokens, segments, loss-bearing tokens. One sequence is open at a
time; the example that fits and has the highest dot product with the residual capacity
goes next, until none fits. Each task packs its own rows batch by batch and holds back a
few examples, never more than a batch, so memory is bounded and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusforge.llm.common import query, small_batches, strings, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END = 0
LONG_TEXT = 1 << 20
ROWS = 1024  # texts packed at a time


def load_encoder(tokenizer: str = TOKENIZER, ranks: str = RANKS) -> Callable[[str], np.ndarray]:
    """Ids as the tokenizers file gives them, without special tokens added.

    ``ranks`` is the same vocabulary for a faster library with equal results. Texts that
    hold a special token, and very long ones, go to the tokenizers file itself.
    """
    import base64
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known,
                             special_tokens={})
    with open(tokenizer, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file).get("added_tokens", [])]
    exact: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        if len(text) < LONG_TEXT and not any(s in text for s in special):
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        if not exact:
            exact.append(Tokenizer.from_file(tokenizer))
        return np.array(exact[0].encode(text, add_special_tokens=False).ids, "<u4")

    return encode


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be at least 1")

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.float64)


Piece = tuple[int, int, int]  # example, start, length


def cut(example: int, length: int, loss_from: int, limits: Limits) -> list[Piece]:
    """Pieces no longer than a sequence and no richer in loss than one may be."""
    pieces, at = [], 0
    while at < length:
        end = min(length, at + limits.tokens, max(at, loss_from) + limits.loss)
        pieces.append((example, at, end - at))
        at = end
    return pieces


def fill(vectors: np.ndarray, limits: Limits, keep_back: bool) -> tuple[list[list[int]], np.ndarray]:
    """Rows of ``vectors`` as sequences, and the rows held back.

    A row that fills a sequence has it to itself. Rows are held back once what is left
    fills only a few sequences.
    """
    capacity = limits.vector()
    full = vectors[:, 0] == limits.tokens
    sequences = [[row] for row in np.flatnonzero(full).tolist()]
    order = np.flatnonzero(~full)
    order = order[np.argsort(-vectors[order, 0], kind="stable")]
    vectors = vectors[order]
    shares = vectors / capacity
    rest = vectors.sum(axis=0)
    while len(order) and not (keep_back and (rest < 4 * capacity).all()):
        residual, chosen = capacity.copy(), []
        open_ = np.ones(len(order), bool)
        while True:
            fits = np.flatnonzero(open_ & (vectors[:, 0] <= residual[0]) & (vectors[:, 2] <= residual[2]))
            if not len(fits) or residual[1] < 1:
                break
            row = int(fits[np.argmax(shares[fits] @ (residual / capacity))])
            chosen.append(row)
            open_[row] = False
            residual -= vectors[row]
        sequences.append(order[chosen].tolist())
        rest = rest - vectors[chosen].sum(axis=0)
        order, vectors, shares = order[open_], vectors[open_], shares[open_]
    return sequences, order


def pack_rows(batches: Iterator[tuple[list, list[np.ndarray], list[int]]], limits: Limits,
              first: int) -> Iterator[list[dict]]:
    """Pieces with their sequence and offset, for batches of (keys, ids, loss_from)."""
    number = first
    held: list[tuple] = []  # key, ids of the piece, start, whole length, loss of the piece

    def pack(rows: list[tuple], keep_back: bool) -> list[dict]:
        nonlocal number, held
        vectors = np.array([(len(ids), 1, loss) for _, ids, _, _, loss in rows], np.float64).reshape(-1, 3)
        sequences, back = fill(vectors, limits, keep_back)
        out = []
        for sequence in sequences:
            offset = 0
            for row in sequence:
                key, ids, start, length, loss = rows[row]
                out.append(key | {"start": start, "length": len(ids), "ids": ids.tobytes(),
                                  "doc_tokens": length, "loss_tokens": loss,
                                  "sequence_id": number, "offset": offset})
                offset += len(ids)
            number += 1
        held = [rows[i] for i in back]
        return out

    for keys, ids, loss_from in batches:
        rows = held
        for i, tokens in enumerate(ids):
            for _, start, n in cut(i, len(tokens), loss_from[i], limits):
                loss = max(0, start + n - max(start, loss_from[i]))
                rows.append((keys[i], tokens[start : start + n], start, len(tokens), loss))
        yield pack(rows, keep_back=True)
    yield pack(held, keep_back=False)


PIECES = ("start long, length long, ids binary, doc_tokens long, loss_tokens long, "
          "sequence_id long, offset long")


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", prompt: str | None = None,
               limits: Limits = Limits(), tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """Encode texts, end each with id 0 and pack them: one row per piece.

    Columns: ``key``, start, length, ids (little-endian 32-bit), doc_tokens, loss_tokens,
    sequence_id, offset. An example longer than a sequence is cut; every id lies in one
    piece. With ``prompt``, a column of texts, the prompt is put before the text and bears
    no loss. Null texts and prompts are empty; an empty example is its end id. Repeated
    rows are packed as often as they come; other columns are not returned. Sequence ids
    are unique, not gapless: each task numbers its own.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer, ranks)

        def examples() -> Iterator[tuple[list, list[np.ndarray], list[int]]]:
            keys, ids, loss_from = [], [], []
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    asked = strings(batch.column(2)) if prompt else [""] * batch.num_rows
                    for k, before, body in zip(batch.column(0).to_pylist(), asked, strings(batch.column(1))):
                        head = encode(before)
                        keys.append({key: k})
                        ids.append(np.concatenate([head, encode(body), np.array([END], "<u4")]))
                        loss_from.append(len(head))
                        if len(ids) == ROWS:  # however many rows a batch has
                            yield keys, ids, loss_from
                            keys, ids, loss_from = [], [], []
            if ids:
                yield keys, ids, loss_from

        first = TaskContext.get().partitionId() << 40
        for rows in pack_rows(examples(), limits, first):
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([(key, to_arrow_type(kind)), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64())])
    columns = [key, text, *([prompt] if prompt else [])]
    return docs.select(*columns).mapInArrow(encoded, f"`{key}` {kind.simpleString()}, {PIECES}")


@query("op6_vector_packing")
def vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_texts(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "loss_tokens")

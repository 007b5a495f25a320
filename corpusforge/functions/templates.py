"""Prompt templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import strip_literal_nbsp, trim

# The parts of each template. ``{name}`` is a field, a pair makes the
# part appear only when its field is not empty, ``eos``/``bos`` are special tokens.
# Fields named in TRIMMED are stripped, those in CLEANED also lose literal "\xa0".
TEMPLATES: dict[str, dict[str, list]] = {
    "summary": {
        "prompt_text": ["내용: ", "{text}", "\n요약: "],
        "label_text": ["{summary}"],
    },
    "instruction": {
        "prompt_text": ["<usr>", "{instruction}", "\n", ("{input}", "\n")],
        "label_text": ["<sys>", "{output}"],
    },
    "lyrics": {
        "text": ["제목: ", "{title}", "\n아티스트: ", "{artist}", "\n가사:\n", "{lyrics}", "eos"],
    },
    "topic": {"text": ["topic: ", "{label}", "\n", "{text}", "eos"]},
    "news": {"text": ["Title: ", "{headline}", "\nContent: ", "{description}"]},
    "news_description": {"text": ["{description}"]},
    "sentence_pair": {"text": ["1: ", "{sentence1}", "\n2:", "{sentence2}"]},
    "plain": {"text": ["bos", "{text}", "eos"]},
}
TRIMMED = {("lyrics", "lyrics")}
CLEANED = {("topic", "text"), ("plain", "text")}


def _render(name: str, parts: list, fields: Mapping[str, Column], eos: str, bos: str) -> Column:
    def part(piece) -> Column:
        if isinstance(piece, tuple):
            field, suffix = piece
            value = part(field)
            return F.when(F.length(value) > 0, F.concat(value, F.lit(suffix))).otherwise("")
        if piece in ("eos", "bos"):
            return F.lit(eos if piece == "eos" else bos)
        if piece.startswith("{") and piece.endswith("}"):
            field = piece[1:-1]
            value = fields[field]
            if (name, field) in TRIMMED:
                value = trim(value)
            if (name, field) in CLEANED:
                value = strip_literal_nbsp(value)
            return value
        return F.lit(piece)

    return F.concat(*[part(p) for p in parts])


def apply_template(df: DataFrame, name: str, mapping: Mapping[str, str | Column] | None = None,
                   eos: str = "</s>", bos: str = "<s>") -> DataFrame:
    """Add the text columns of a template; ``mapping`` names the column of each field."""
    spec = TEMPLATES[name]
    mapping = mapping or {}
    names = {p[1:-1] for parts in spec.values() for piece in parts
             for p in (piece if isinstance(piece, tuple) else (piece,)) if p.startswith("{")}
    fields = {}
    for field in names:
        source = mapping.get(field, field)
        fields[field] = F.col(source) if isinstance(source, str) else source
    return df.withColumns({
        out: _render(name, parts, fields, eos, bos) for out, parts in spec.items()
    })

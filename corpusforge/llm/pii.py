"""Personal data in plain and disguised forms, as spans of the source text.

A chain of small transducers rewrites a text: look-alike characters become ASCII,
invisible characters vanish, spelled digits become digits, ``(at)`` and ``[dot]``
become signs. Each output character remembers the source characters it came from,
so what the detectors find in the rewritten text maps back to the source. The plain
text is searched as well; those base spans are never changed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm.common import by_slices, query, strings, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin at the first digit of a run: the run before is eaten whole.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[Span]:
    """From each ``@`` outwards: linear, where a search from the left is quadratic."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[Span]:
    for found in ADDRESS.finditer(text):
        parts = [p.lstrip("0") for p in found.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield found.span()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for found in CARD.finditer(text):
        if found.end() - found.start() >= 12:
            digits = found.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[Span]:
    for found in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(found.group())) <= 15:
            yield found.span()


DETECTORS = tuple(zip(KINDS, (emails, addresses, cards, phones)))


# Digits spelled in the four languages of the corpus, from zero to nine.
SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGIT_OF = {word: str(d) for line in SPELLED for d, word in enumerate(line.split())} | {"oh": "0"}
SIGN_OF = {"dot": ".", "point": ".", "punkt": ".", "punto": ".", "plus": "+", "dash": "-",
           "hyphen": "-"}
# Letters of other scripts that look like the ASCII letter below them.
LOOK_ALIKE = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧο‐‑‒–−․。｡．",
                      "ABESIJKMHOPCTXYaesijopcyxdqwABEZHIKMNOPTYXo-----...."))
INVISIBLE = "­​‌‍⁠﻿"


@lru_cache(maxsize=1 << 16)
def plain(char: str) -> str | None:
    """The ASCII character that ``char`` stands for, "" if it is invisible, else None."""
    if char in INVISIBLE:
        return ""
    if char in LOOK_ALIKE:
        return LOOK_ALIKE[char]
    if unicodedata.category(char) == "Nd":
        return str(unicodedata.decimal(char))
    folded = unicodedata.normalize("NFKC", char)
    kind = unicodedata.decomposition(char)
    wide = kind.startswith(("<wide>", "<font>", "<small>", "<narrow>")) or kind.startswith("<circle>") and folded.isdigit()
    return folded if wide and len(folded) == 1 and folded.isascii() else None


_word = "|".join(sorted([*DIGIT_OF, *SIGN_OF], key=len, reverse=True))
_gap = r"[\x20\t,_-]{1,3}"
SPELLED_RUN = re.compile(rf"(?<!\w)(?:{_word})(?:{_gap}(?:{_word}))+(?!\w)", re.IGNORECASE)
SPELLED_WORD = re.compile(rf"(?<!\w)(?:{_word})(?!\w)", re.IGNORECASE)
LEAST_SPELLED = 4  # fewer digit words in a row are prose
_open, _shut = r"[\x20\t]{0,3}[\[({<][\x20\t]{0,3}", r"[\x20\t]{0,3}[\])}>][\x20\t]{0,3}"
_bracketed = rf"{_open}(?:dot|punkt|punto|point|\.){_shut}"
_bare = r"[\x20\t]{1,3}(?:dot|punkt|punto|point)[\x20\t]{1,3}"
_dot = rf"(?:{_bracketed}|{_bare})"
_label = r"[A-Za-z0-9-]{1,63}"
# Last labels that end a name disguised by bare words; prose has "at" and "dot" too.
_sure = """com org net edu gov mil int info biz io co eu us uk de fr es it nl ch at ca au ru cn jp kr in br
    ac ad ae af ag ai al ao aq ar aw ax az ba bb bd bf bg bh bi bj bm bn bo bq bs bt bv bw by bz cc cd cf cg
    ci ck cl cm cr cu cv cw cx cy cz dj dk dm dz ec ee eg er et fi fj fk fm fo ga gb gd ge gf gg gh gi gl gm
    gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im iq ir je jm jo ke kg kh ki km kn kp kw ky kz la
    lb lc li lk lr ls lt lu lv ly ma mc md mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx mz na nc ne nf ng
    ni np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs rw sa sb sc sd se sg sh si sj sk
    sl sm sn sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn tr tt tv tw tz ua ug uy uz va vc ve vg vi
    vn vu wf ws ye yt za zm zw app dev xyz tech aero coop museum mobi arpa asia gmbh blog wiki wien berlin
    hamburg koeln paris cat swiss london"""
# English words as well, so they must end a line, a clause or a bracket.
_prose = """am as be do is me my no so to cloud online site shop store club page email live news world agency
    digital solutions services systems network company center group global space website top work team media
    design studio art games host press social support software tools today zone academy education health care
    bank law legal finance post name pro jobs travel one fun life plus run link click help guide"""
_clause = r"""(?=[\x20\t]{0,3}(?:[\n\r.,;:!?)\]}>"']|\Z))"""
_last = f"(?:{'|'.join(_sure.split())}|(?:{'|'.join(_prose.split())}){_clause})"
DOT = re.compile(_dot, re.IGNORECASE)
_ends = r"(?![A-Za-z0-9-])"
_dotted = rf"{_label}(?:(?:\.|{_dot}){_label}){{0,4}}(?:\.|{_dot}){_last}{_ends}"
_at = "at|arroba|arobase"
AT = re.compile(
    rf"(?<=[A-Za-z0-9._%+-])(?:{_open}(?:{_at}|@){_shut}(?=[A-Za-z0-9])"
    rf"|{_open}a{_shut}(?={_dotted})"
    rf"|(?:[\x20\t]{{1,3}}@[\x20\t]{{0,3}}|@[\x20\t]{{1,3}}|[\x20\t]{{1,3}}(?:arroba|arobase)[\x20\t]{{1,3}})(?={_dotted})"
    rf"|[\x20\t]{{1,3}}at[\x20\t]{{1,3}}"
    rf"(?={_label}(?:(?:\.|{_dot}){_label}){{0,4}}{_dot}{_last}{_ends}))",
    re.IGNORECASE)
# "at" before a plain name is prose ("see us at example.com") unless the word before it looks like a
# mailbox or mail is spoken of.
PLAIN_AT = re.compile(
    rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{{1,64}})([\x20\t]{{1,3}}at[\x20\t]{{1,3}})"
    rf"(?={_label}(?:\.{_label}){{0,4}}\.{_last}{_ends})", re.IGNORECASE)
MAILBOX = re.compile(r"[A-Za-z0-9][._%+-]+[A-Za-z0-9]|[A-Za-z][0-9]")
SPOKEN_OF = re.compile(
    r"(?<!\w)(?:e-?mail|mail|mailto|contact|kontakt|correo|courriel|write[\x20\t]to)[\x20\t]{0,3}[:=-]?[\x20\t]{0,3}(?:is[\x20\t])?\Z", re.IGNORECASE)
# A bare "dot" belongs to the name if another dot follows or the last label is a known one.
DOTTED = re.compile(
    rf"@{_label}(?:(?:\.|{_bracketed}){_label}|{_bare}(?:{_label}(?=\.|{_dot})|{_last}(?![A-Za-z0-9-])))+",
    re.IGNORECASE)
# Between digits, and before one, the detectors judge what the rewritten text is.
DIGITS_DOT = re.compile(
    rf"(?<=[0-9])(?:{_bracketed}|[\x20\t]{{1,3}}(?:dot|punkt|punto|point)[\x20\t]{{1,3}})(?=[0-9])", re.IGNORECASE)
PLUS = re.compile(
    rf"(?:[\[({{<][\x20\t]{{0,3}}(?:plus|\+){_shut}|(?<!\w)plus[\x20\t]{{1,3}})(?=\(?[0-9])", re.IGNORECASE)
ENTITY = re.compile(r"&(?:#(?:x([0-9A-Fa-f]{1,6})|([0-9]{1,7}))|(commat|period|plus|lowbar|hyphen));")
NAMED = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "hyphen": "-"}
BRACKETED = re.compile(rf"[\[({{<][\x20\t]{{0,3}}(?:{_at}|a|[@.+])[\x20\t]{{0,3}}[\])}}>]", re.IGNORECASE)
SPACED_AT = re.compile(r"[\x20\t]@|@[\x20\t]")
# Letters that match an ASCII letter when case is ignored, and that lower() leaves alone or splits.
FOLD = str.maketrans("ıİſ", "iis")
# Lower case, and white space for everything that can stand around a spelled ASCII word.
AS_WORDS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))
AT_WORDS = frozenset(w.encode() for w in _at.split("|"))
SIGN_WORDS = frozenset(w.encode() for w in ("dot", "punkt", "punto", "point", "plus"))
DIGIT_WORDS = frozenset(w.encode() for w in DIGIT_OF if w.isascii())
ACCENTED_WORDS = tuple(w for w in DIGIT_OF if not w.isascii())


def without_case(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(FOLD).lower()


def may_be_disguised(text: str) -> bool:
    """False only if the rewriting of words and signs cannot change anything."""
    folded = without_case(text)
    words = folded.encode().translate(AS_WORDS).split()
    if not SIGN_WORDS.isdisjoint(words):
        return True
    spelled = 0 if DIGIT_WORDS.isdisjoint(words) else sum(w in DIGIT_WORDS for w in words)
    if not text.isascii():
        spelled += sum(map(folded.count, ACCENTED_WORDS))
    return (spelled >= LEAST_SPELLED or BRACKETED.search(text) is not None
            or not AT_WORDS.isdisjoint(words) and (PLAIN_AT.search(text) or AT.search(text)) is not None
            or SPACED_AT.search(text) is not None)


class Rewritten:
    """A text with, for each character, where its source characters begin and end."""

    def __init__(self, text: str):
        self.text, self.begins, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, changes: list[tuple[int, int, str]]) -> None:
        """Put strings in place of spans (ordered, disjoint); each maps to its whole span."""
        if not changes:
            return
        out, begins, ends, at = [], [], [], 0
        for start, end, new in [*changes, (len(self.text), len(self.text), "")]:
            out.append(self.text[at:start])
            begins.extend(self.begins[at:start])
            ends.extend(self.ends[at:start])
            if new:
                out.append(new)
                begins.extend([self.begins[start]] * len(new))
                ends.extend([self.ends[end - 1]] * len(new))
            at = end
        self.text, self.begins, self.ends = "".join(out), begins, ends

    def source(self, start: int, end: int) -> Span:
        return self.begins[start], self.ends[end - 1]


def unmask_characters(rewritten: Rewritten) -> None:
    text = rewritten.text
    if text.isascii():
        return
    known = {c: plain(c) for c in set(text) if not c.isascii()}
    known = {c: p for c, p in known.items() if p is not None}
    if known:
        rewritten.replace([(i, i + 1, known[c]) for i, c in enumerate(text) if c in known])


def unescape_entities(rewritten: Rewritten) -> None:
    """Numeric character references of ASCII characters, and the names of signs of an address."""
    changes = []
    for found in ENTITY.finditer(rewritten.text) if "&" in rewritten.text else ():
        if found[3]:
            changes.append((*found.span(), NAMED[found[3]]))
            continue
        code = int(found[1], 16) if found[1] else int(found[2])
        if 32 <= code < 127:
            changes.append((*found.span(), chr(code)))
    rewritten.replace(changes)


def unspell_digits(rewritten: Rewritten) -> None:
    changes = []
    for run in SPELLED_RUN.finditer(rewritten.text):
        words = list(SPELLED_WORD.finditer(rewritten.text, *run.span()))
        signs = [DIGIT_OF.get(w) or SIGN_OF[w] for w in (without_case(w.group()) for w in words)]
        if sum(s.isdigit() for s in signs) < LEAST_SPELLED:
            continue
        last = run.start()
        for word, sign in zip(words, signs):
            if word.start() > last:
                changes.append((last, word.start(), ""))
            changes.append((*word.span(), sign))
            last = word.end()
    rewritten.replace(changes)


def undisguise_signs(rewritten: Rewritten) -> None:
    rewritten.replace([(*m.span(), "@") for m in AT.finditer(rewritten.text)])
    rewritten.replace([
        (*m.span(2), "@") for m in PLAIN_AT.finditer(rewritten.text)
        if MAILBOX.search(m[1]) or SPOKEN_OF.search(rewritten.text[max(0, m.start() - 24) : m.start()])])
    rewritten.replace([
        (*dot.span(), ".")
        for domain in DOTTED.finditer(rewritten.text)
        for dot in DOT.finditer(rewritten.text, *domain.span())
    ])
    rewritten.replace([(*m.span(), ".") for m in DIGITS_DOT.finditer(rewritten.text)])
    rewritten.replace([(*m.span(), "+") for m in PLUS.finditer(rewritten.text)])


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of every identifier, by start and then kind.

    Disguised ones are added where they overlap no base span of their kind, or
    hold one and go beyond it.
    """
    base = {kind: list(find(text)) for kind, find in DETECTORS}
    found = [(kind, *span, True) for kind, spans in base.items() for span in spans]
    rewritten = Rewritten(text)
    unescape_entities(rewritten)
    unmask_characters(rewritten)
    if may_be_disguised(rewritten.text):
        unspell_digits(rewritten)
        undisguise_signs(rewritten)
    if rewritten.text is not text:
        for kind, find in DETECTORS:
            for span in find(rewritten.text):
                start, end = rewritten.source(*span)
                meets = [(s, e) for s, e in base[kind] if s < end and start < e]
                if all(start <= s and e <= end and (start, end) != (s, e) for s, e in meets):
                    found.append((kind, start, end, False))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()),
]))


@F.arrow_udf(SPANS)
def spans_of(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                               ("end", pa.int64()), ("base", pa.bool_())]))
    return by_slices(lambda texts: pa.array(
        [[dict(zip(("kind", "start", "end", "base"), f)) for f in find_spans(t)] for t in strings(texts)], kind), text)


def identifier_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: the identifiers of each text, offsets in code points, end exclusive.

    Null and empty texts have none. All other columns stay; a column that is already
    called ``out`` is replaced. Rows are independent, so repeated rows give equal
    results and an empty table gives an empty one. Texts are read whole; every
    detector is linear in the length of the text.
    """
    return docs.withColumn(out, spans_of(F.col(text)))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op1_pii_spans")
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifier_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_disguised"),
    )

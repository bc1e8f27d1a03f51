"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Each kind has a pattern.  What it proposes is confirmed by a check of its own:
parts of an address up to 255, the Luhn sum of a card, the remainder of an
account number by 97, the number of digits of a telephone number, numbers that
are issued at all.  A confirmed span begins with its kind's score; a word of the
kind among the ``CONTEXT`` characters before it raises the score, a word that
speaks of other numbers lowers it.

The base kinds (e-mail, ip, card, phone) are kept whatever their score, so that
a caller can draw another line; the added kinds (iban, ssn, local_phone) are
kept from the threshold on.  Account numbers pass by their checksum alone, the
other two need a word beside them.

Places are code points, ends are exclusive.  Spans of one base kind do not
overlap, those of different kinds may.  Every pattern is matched in time linear
in the text, whatever the text: runs of digits are taken whole and e-mail
addresses are sought from their ``@``.

Null texts count as empty and have no spans.  Repeated rows are each answered,
null numbers too; an empty table gives an empty result; other columns are not
read, except by :func:`redact`, which returns them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, text_slices

#: Kinds in the order in which spans with the same start are listed.
BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["iban", "ssn", "local_phone"]
KINDS = [*BASE_KINDS, *ADDED_KINDS]
#: Hundredths: what a confirmed span of a kind has, and what words nearby add or take.
SCORES = {"email": 90, "ip": 60, "card": 80, "phone": 60, "iban": 90, "ssn": 40, "local_phone": 30}
RAISED, LOWERED = 40, 20
#: An added span is kept from here on.
THRESHOLD = 60
#: Code points before a span in which words count.
CONTEXT = 40
WORDS = {
    "email": ["email", "mail", "contact"],
    "ip": ["ip", "host", "address", "server"],
    "card": ["card", "visa", "mastercard", "credit", "debit", "payment"],
    "phone": ["phone", "tel", "telephone", "call", "mobile", "cell", "fax"],
    "iban": ["iban", "account", "bank", "konto"],
    "ssn": ["ssn", "social", "security", "insurance"],
    "local_phone": ["phone", "tel", "telephone", "call", "mobile", "cell", "fax"],
}
OTHER_NUMBERS = ["order", "invoice", "isbn", "version", "article", "serial"]
#: Characters of an account number by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

_DIGIT = re.compile("[0-9]")
_LOCAL_PART = frozenset(UPPER + LOWER + "0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Whole chains, so that no digit is looked at twice; fours of their numbers are addresses.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN = {n: re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN_LENGTHS.values())}
_SSN = re.compile(r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])")
_LOCAL = re.compile(r"(?<![0-9A-Za-z+().-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])")
_FOLD = str.maketrans(UPPER, LOWER)
_WORD = re.compile("[a-z]+")
_WORD_SETS = {k: frozenset(v) for k, v in WORDS.items()}
_OTHER_SET = frozenset(OTHER_NUMBERS)


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: int


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled and summed by digits, and the others give a multiple of ten."""
    doubled = digits[-2::-2].translate(str.maketrans("0123456789", "0246813579"))
    return (sum(map(int, digits[-1::-2])) + sum(map(int, doubled))) % 10 == 0


def mod_97(account: str) -> bool:
    """Whether the account number, its first four characters put last and letters counted from 10, leaves 1 by 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_PART:  # runs hold no sign, so none is read twice
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        numbers = chain.group().split(".")
        start = chain.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(n := x.lstrip("0")) < 3 or len(n) == 3 and n <= "255" for x in four):
                yield start, end
            start = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    for head in _IBAN_HEAD.finditer(text):
        whole = (n := IBAN_LENGTHS.get(head.group()[:2])) and _IBAN[n].match(text, head.start())
        if whole and mod_97(whole.group().replace(" ", "")):
            yield whole.span()


def _social_numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _LOCAL.finditer(text):
        yield m.span()


_FINDERS = {"ip": _addresses, "card": _cards, "phone": _phones, "iban": _accounts, "ssn": _social_numbers, "local_phone": _local_phones}


def score(text: str, kind: str, start: int) -> int:
    words = set(_WORD.findall(text[max(0, start - CONTEXT) : start].translate(_FOLD)))
    return min(100, SCORES[kind] + RAISED * bool(words & _WORD_SETS[kind]) - LOWERED * bool(words & _OTHER_SET))


def find_spans(text: str, threshold: int = THRESHOLD) -> list[Span]:
    """All spans of a text by start, then by kind."""
    found = [Span("email", s, e, score(text, "email", s)) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, finder in _FINDERS.items():
            for s, e in finder(text):
                points = score(text, kind, s)
                if kind in BASE_KINDS or points >= threshold:
                    found.append(Span(kind, s, e, points))
    return sorted(found, key=lambda x: (x.start, KINDS.index(x.kind)))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.int32())])
_FOUND = "array<struct<kind:string,start:int,end:int,score:int>>"


def personal_spans(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id and spans (array of kind, start, end, score in hundredths; by start, then kind) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            spans = [[{"kind": x.kind, "start": x.start, "end": x.end, "score": x.score} for x in find_spans(t, threshold)] if t else [] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, f"doc_id long, spans {_FOUND}")


def redact(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with each span replaced by its kind in square brackets; of spans that overlap, the first (by start, then kind) stands for all that it meets.

    Null texts stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = []
            for text in part.column("text").to_pylist():
                pieces, at = [], 0
                for x in find_spans(text, threshold) if text else []:
                    if x.start >= at:
                        pieces += [text[at : x.start], f"[{x.kind}]"]
                    at = max(at, x.end)
                texts.append(text and "".join(pieces) + text[at:])
            where = part.schema.get_field_index("text")
            yield part.set_column(where, part.schema.field(where), pa.array(texts, part.schema.field(where).type))

    return docs.mapInArrow(run, docs.schema)


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def personal_data(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Of every row: doc_id, the number of spans of each base kind, base_sha256, spans, the number of added spans and the highest score (null without spans)."""
    rows = personal_spans(docs, threshold)
    of = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    base = F.filter("spans", lambda x: x.kind.isin(BASE_KINDS))
    return rows.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x.kind.isin(ADDED_KINDS))).cast("long").alias("n_added"), F.array_max(F.transform("spans", lambda x: x.score)).alias("best_score"),
    )

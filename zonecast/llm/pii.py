"""Personal data: patterns propose spans, checksums confirm them, nearby context words move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of kinds at one start; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
BASE = KINDS[:4]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key)["']?\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9_+/=-]{8,}+)""")
DIGITS = re.compile(r"[0-9]")

#: Score of a proposal, by kind, before its context is read; a checksum has already removed what fails it.
PRIOR = {"iban": 0.9, "ssn": 0.4, "local_phone": 0.4, "secret": 0.8}
#: Words near a span that speak for its kind or against it, with what they add. Any kind can meet the words against.
FOR = {
    "iban": {"iban": 0.1, "account": 0.1, "bank": 0.1},
    "ssn": {"ssn": 0.5, "social": 0.3, "security": 0.3, "taxpayer": 0.3},
    "local_phone": {"phone": 0.4, "tel": 0.4, "call": 0.3, "fax": 0.4, "mobile": 0.4, "telefon": 0.4, "teléfono": 0.4, "téléphone": 0.4},
    "secret": {"token": 0.1, "key": 0.1},
}
AGAINST = {"example": -0.2, "order": -0.3, "invoice": -0.3, "version": -0.3, "isbn": -0.4, "part": -0.2}
WORD = re.compile(r"\w+")


class Span(NamedTuple):
    start: int
    rank: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; each @ is met once, so that long runs cost linear time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Every four numbers of a dotted run make a match; it counts if none is over 255."""
    for run in DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        bounds = []
        for part in parts:
            bounds.append((at, at + len(part)))
            at += len(part) + 1
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[i : i + 4]):
                yield bounds[i][0], bounds[i + 3][1]


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in DIGIT_RUN.finditer(text):
        digits = run.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(run.group())) <= 15:
            yield run.span()


def _context(text: str, start: int, end: int, kind: str, reach: int) -> float:
    near = WORD.findall(text[max(0, start - reach) : start].lower() + " " + text[end : end + reach].lower())
    words = FOR[kind] | AGAINST
    return sum(words.get(w, 0.0) for w in set(near))


def find_spans(text: str, least_score: float = 0.5, reach: int = 40) -> list[Span]:
    """All spans of a text, by start and kind. Base spans have score 1; the others' scores come from checksum and context."""
    found = []
    digits = DIGITS.search(text) is not None
    if "@" in text:
        found += [Span(i, 0, j, 1.0) for i, j in emails(text)]
    if digits:
        for rank, proposals in enumerate((addresses, cards), 1):
            found += [Span(i, rank, j, 1.0) for i, j in proposals(text)]
        if "+" in text:
            found += [Span(i, 3, j, 1.0) for i, j in phones(text)]
        taken = [(s.start, s.end) for s in found]
        for kind, pattern, check in (("iban", IBAN, mod97), ("ssn", SSN, None), ("local_phone", LOCAL_PHONE, None)):
            for run in pattern.finditer(text):
                start, end = run.span()
                if (check is None or check(run.group())) and not any(i <= start and end <= j for i, j in taken):
                    score = PRIOR[kind] + _context(text, start, end, kind, reach)
                    if score >= least_score:
                        found.append(Span(start, KINDS.index(kind), end, min(1.0, score)))
    if "=" in text or ":" in text:
        for run in SECRET.finditer(text):
            start, end = run.span(1)
            if DIGITS.search(text, start, end):
                score = PRIOR["secret"] + _context(text, start, end, "secret", reach)
                if score >= least_score:
                    found.append(Span(start, KINDS.index("secret"), end, min(1.0, score)))
    return sorted(found)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are one, of the first's kind."""
    parts, at = [], 0
    for span in spans:
        if span.start >= at:
            parts += [text[at : span.start], f"<{KINDS[span.rank]}>"]
        at = max(at, span.end)
    return "".join([*parts, text[at:]])


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect_pii(
    docs: DataFrame, least_score: float = 0.5, reach: int = 40, redacted: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end, score; code points, end exclusive) and, if asked for, redacted_text.

    Base kinds (email, ip, card, phone) follow fixed patterns and checks and always stay; IBANs (mod 97), social
    security numbers, local phone numbers and secrets are added where checksum and the context words within
    ``reach`` characters give ``least_score``, except wholly inside a base span. A null or empty text has no spans and
    is redacted to an empty text. Whole texts are read, in time that grows linearly with them. Rows are
    independent: repeated rows repeat, null ids pass through, other columns are not read, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                own = find_spans(text, least_score, reach)
                spans.append([{"kind": KINDS[s.rank], "start": s.start, "end": s.end, "score": s.score} for s in own])
                if redacted:
                    clean.append(redact(text, own))
            columns = {"doc_id": batch.column(0), "spans": pa.array(spans, SPAN_TYPE)}
            if redacted:
                columns["redacted_text"] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long,score:double>>"
    return source.mapInArrow(run, schema + ", redacted_text string" * redacted)

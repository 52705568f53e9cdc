"""Personal data in texts: patterns propose, checksums confirm, context adjusts the score.

Four kinds follow fixed rules and are always reported: ``email``, ``ip``, ``card`` (Luhn)
and ``phone``. Two more are found by the same method and reported when their score says
so: ``iban`` (mod 97) and ``ssn`` (a pattern that needs a context word beside it).
Places are code points, end exclusive. A null or empty text has no spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.llm import tables

NAME = "op5_personal_data"
ORACLE = None  # repeated matches with places and a Luhn sum: checked against plain patterns

# The kinds in order, and their patterns.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "ssn"]
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The lookbehind and the possessive runs change no match; they keep long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# The length of an account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
CONTEXT = {
    "email": {"mail", "email", "e-mail", "contact", "write"},
    "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "mastercard", "credit", "payment"},
    "phone": {"phone", "call", "tel", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ssn": {"ssn", "social", "security"},
}
#: Score of a confirmed pattern, what a context word adds, and what the added kinds need.
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT_BONUS, NEEDED, CONTEXT_CHARS = 0.2, 0.6, 40
_WORD = re.compile(r"[a-z-]+")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with the run of local characters before it, as the pattern would match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that end where their country's length says, whatever word follows.

    Of a country without a known length the whole match must pass.
    """
    m = _IBAN.search(text)
    while m:
        start, end, at = *m.span(), m.start() + 4
        known = IBAN_LENGTH.get(text[start : start + 2])
        if known:
            places = [i for i in range(start, end) if text[i] != " "]
            end = places[known - 1] + 1 if len(places) >= known else start
        compact = text[start:end].replace(" ", "")
        if 15 <= len(compact) <= 34 and not text[end : end + 1].isalnum() and mod97(compact):
            yield start, end
            at = end
        m = _IBAN.search(text, at)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass the check of their kind."""
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span()
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()


def find_spans(text: str) -> list[Span]:
    """All spans of a text by start, then kind in the order of ``KINDS``."""
    out = []
    for kind, start, end in _proposed(text):
        around = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
        near = CONTEXT[kind].intersection(_WORD.findall(around.lower()))
        score = min(1.0, BASE_SCORE[kind] + CONTEXT_BONUS * bool(near))
        if kind in BASE_KINDS or score >= NEEDED:
            out.append(Span(start, end, kind, round(score, 2)))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    parts, done = [], 0
    for span in found:
        if span.start >= done:
            parts += [text[done : span.start], f"<{span.kind.upper()}>"]
        done = max(done, span.end)
    return "".join([*parts, text[done:]]) if parts else text


SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


def with_spans(docs: DataFrame, text: str = "text", spans: str = "pii_spans", masked: str = "pii_text") -> DataFrame:
    """Add the spans of each text and the text without them; all other columns pass through.

    ``docs`` must not hold columns of the two new names. A null text stays null.
    """
    both = pa.struct([(spans, _SPANS), (masked, pa.string())])

    @F.arrow_udf(f"struct<{spans}:{SPANS},{masked}:string>")
    def scan(column: pa.Array) -> pa.Array:
        out = []
        for part in tables.slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
            rows = []
            for t in part.column(0).to_pylist():
                found = find_spans(t or "")
                rows.append({spans: [s._asdict() for s in found], masked: redacted(t, found) if found else t})
            out.append(pa.array(rows, both))
        return pa.concat_arrays(out) if out else pa.array([], both)

    # One struct holds both results, so that the texts are read once.
    return docs.withColumn(spans, scan(F.col(text))).select(
        *[c for c in docs.columns], F.col(f"{spans}.{spans}"), F.col(f"{spans}.{masked}")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("pii_spans", lambda s: s["kind"].isin(BASE_KINDS))
    return with_spans(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("pii_spans")).alias("spans"),
        F.aggregate("pii_spans", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced in ``text``, and ``n_chars`` to match."""
    spans, masked = tables.unused(docs, "_spans"), tables.unused(docs, "_masked")
    new = {"text": F.col(masked)}
    if "n_chars" in docs.columns:
        length = F.length(masked).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_chars").isNotNull(), length)
    return with_spans(docs, "text", spans, masked).withColumns(new).select(*docs.columns)

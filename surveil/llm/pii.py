"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Base kinds (always reported; the score never removes them): email, ip, card (Luhn), phone.
The method adds: iban (mod-97 confirms), ssn (no checksum: needs a context word nearby) and account
(a run of 8 to 17 digits next to an account word). An added span counts if its score reaches
``min_score``; score = prior of the kind, plus CHECKED if a checksum holds, plus NEAR if one of the
kind's context words stands within ``window`` code points.

Every scan is linear in the text: an email grows left from its ``@``; digit runs are entered at
their start only (a match cannot start inside a run whose start failed).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "account")
KINDS = BASE_KINDS + EXTRA_KINDS

# fixed values: priors and context words of the kinds
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.5, "iban": 0.3, "ssn": 0.3, "account": 0.1}
CHECKED, NEAR = 0.4, 0.3
CONTEXT = {
    "email": ("mail", "contact", "write", "e-mail"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "sozialversicherung", "sécurité"),
    "account": ("account", "acct", "konto", "compte", "cuenta"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{8,17}(?![0-9A-Za-z.-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NEAR = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, w)) + r")(?!\w)", re.IGNORECASE) for k, w in CONTEXT.items()}


def luhn(digits: str) -> bool:
    """Luhn checksum of a digit string."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod-97 check of an IBAN without spaces."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed base spans, kinds in order, then by start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _near(kind: str, text: str, a: int, b: int, window: int) -> bool:
    return bool(_NEAR[kind].search(text, max(0, a - window), a) or _NEAR[kind].search(text, b, b + window))


def scored_spans(text: str, window: int = 40, min_score: float = 0.6) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score): the base ones, then added ones that overlap none of them."""
    base = base_spans(text)
    out = [(k, a, b, min(1.0, PRIOR[k] + CHECKED * (k == "card") + NEAR * _near(k, text, a, b, window))) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    for kind, pattern in (("iban", _IBAN), ("ssn", _SSN), ("account", _ACCOUNT)):
        for m in pattern.finditer(text):
            a, b = m.span()
            checked = kind == "iban" and mod97(m.group().replace(" ", ""))
            score = PRIOR[kind] + CHECKED * checked + NEAR * _near(kind, text, a, b, window)
            if kind == "iban" and not checked or kind == "account" and not _near(kind, text, a, b, window):
                continue
            if kind == "account":
                score += NEAR
            if score >= min_score - 1e-9 and not any(x < b and a < y for x, y in taken):
                out.append((kind, a, b, min(1.0, score)))
                taken.append((a, b))
    return out


def redact(text: str, spans: list[tuple]) -> str:
    """``text`` with each span (overlapping ones joined) replaced by ``<KIND>`` of its first span."""
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, window: int = 40, min_score: float = 0.6, text_out: bool = True) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,score>>, redacted) for each row of ``docs``.

    ``text_out=False`` leaves ``redacted`` null: for callers that need the spans alone.

    Uses doc_id and text only, so other columns may have any name. Null or empty text: no spans,
    ``redacted`` stays null or empty. Null doc_id and repeated rows: a result per row. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                texts = batch.column(1).slice(i, 1024).to_pylist()
                spans = [scored_spans(t, window, min_score) if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1024),
                    pa.array([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in x] for x in spans], _SPANS),
                    pa.array([(redact(t, x) if x else t) if text_out else None for t, x in zip(texts, spans)], pa.string())],
                    ["doc_id", "spans", "redacted"])
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
             "spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, redacted string")


def redacted(docs: DataFrame, window: int = 40, min_score: float = 0.6, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by ``<KIND>``; ``size_col``, if present, is recounted."""
    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        parts = []
        for i in range(0, len(text), 256):               # Python copies of a few texts at a time
            part = text.slice(i, 256).to_pylist()
            parts.append(pa.array([redact(t, x) if t and (x := scored_spans(t, window, min_score)) else t for t in part], pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    out = docs.withColumn(text_col, clean(docs[text_col]))
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.char_length(text_col).cast(docs.schema[size_col].dataType))
    return out.select(*docs.columns)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``find``: doc_id, n_<base kind>, base_sha256, spans, n_added, max_score."""
    def of(kinds):
        parts = [f"transform(filter(spans, s -> s.kind = '{k}'), s -> concat_ws(':', s.kind, s.start, s.end))" for k in kinds]
        return F.expr(f"concat_ws(',', concat({', '.join(parts)}))")

    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(of(BASE_KINDS), 256).alias("base_sha256"), of(KINDS).alias("spans"),
        F.expr(f"cast(size(filter(spans, s -> s.kind not in ({base}))) as bigint)").alias("n_added"),
        F.expr("array_max(transform(spans, s -> s.score))").alias("max_score"))

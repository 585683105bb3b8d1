"""Personal data: patterns propose, checksums confirm, context words adjust.

Kinds: email, ip, card (Luhn), phone, found leftmost and non-overlapping for each kind
as the patterns say; the method adds iban (mod-97), and two kinds without a checksum: account
(8 to 17 digits) and national (nine digits in groups of 3, 2 and 4). Offsets are code points,
the end exclusive. Each span has a score: what its kind is worth, more with a checksum,
more or less by the words around it. Base spans stay whatever their score; the others need
``KEEP``: an iban has it by its checksum, the two without one have it only where words
around them speak for them and none against. A stretch that another span holds is not added again.

Null texts read as empty and have no spans. Repeated rows give repeated rows. Patterns
consume a run of characters as a whole, so very long runs take time in proportion.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook.llm import texts as X

KINDS = ("email", "ip", "card", "phone", "iban", "account", "national")
#: Score of a kind's shape alone and with its check passed.
SHAPE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "account": 0.3, "national": 0.4}
#: Words that raise or lower the score of a kind within ``NEAR`` characters on either side.
NEAR, RAISE, LOWER, KEEP = 48, 0.25, 0.3, 0.5
FOR = {
    "email": "mail email contact write",
    "ip": "ip address host server client",
    "card": "card visa mastercard credit debit payment",
    "phone": "phone tel call mobile fax telefon téléphone",
    "iban": "iban account bank konto compte cuenta",
    "account": "account acct iban bank routing konto kontonummer compte cuenta",
    "national": "ssn social security national identity tax sozialversicherung securite sociale dni",
}
AGAINST = "version release order invoice isbn serial example test"

# A local part, a number before a dot: taken whole, so a failing run is passed over once.
EMAIL = re.compile(r"([A-Za-z0-9._%+-]++)(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9.,_+/-])[0-9]{8,17}(?![A-Za-z0-9_/-]|[.,][0-9])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
WORD = re.compile(r"\w+")
_DIGIT = re.compile("[0-9]")
_ONLY = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(value: str) -> bool:
    """The value without blanks, first four characters moved behind, letters as
    10 to 35, leaves 1 on division by 97."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _iban_end(text: str, start: int, end: int) -> int:
    """The longest end, at the match's own or before one of its blanks, at which
    the check passes; 0 if none."""
    while True:
        value = text[start:end].replace(" ", "")
        if len(value) < 15:
            return 0
        if len(value) <= 34 and mod97(value):
            return end
        end = text.rfind(" ", start, end)
        if end < 0:
            return 0


def propose(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text) if m[2]]
    if not _DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].translate(_ONLY)
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    for m in IBAN.finditer(text):
        if end := _iban_end(text, *m.span()):
            out.append(("iban", m.start(), end))
    return out


def numbers(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of numbers of a shape without a checksum, outside the spans found."""
    out = [(kind, *m.span()) for kind, pattern in (("account", ACCOUNT), ("national", NATIONAL)) for m in pattern.finditer(text)]
    if not out:
        return out
    held = bytearray(len(text))
    for _, a, b in spans:
        held[a:b] = b"\1" * (b - a)
    return [s for s in out if not any(held[s[1] : s[2]])]


def scored(text: str) -> list[dict]:
    out, spans = [], propose(text)
    for kind, start, end in spans + (numbers(text, spans) if _DIGIT.search(text) else []):
        near = {w.lower() for w in WORD.findall(text[max(0, start - NEAR) : start]) + WORD.findall(text[end : end + NEAR])}
        score = SHAPE[kind] + RAISE * bool(near & set(FOR[kind].split())) - LOWER * bool(near & set(AGAINST.split()))
        score = round(min(1.0, max(0.0, score)), 4)
        if kind in KINDS[:4] or score >= KEEP:
            out.append({"kind": kind, "start": start, "end": end, "score": score})
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, score), by kind, then start."""

    def columns(batch: pa.RecordBatch) -> list:
        return [batch.column(0), pa.array([scored(t or "") for t in X.strings(batch.column(1))], pa.list_(SPAN))]

    return X.map_batches(X.pairs(df, id_col, text_col), columns, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def mask(text: str) -> str:
    """The text with every span replaced by its kind; of overlapping spans the one
    that starts first names the whole stretch."""
    out, at = [], 0
    ends: list[list] = []
    for s in sorted(scored(text), key=lambda s: (s["start"], -s["end"])):
        if ends and s["start"] < ends[-1][1]:
            ends[-1][1] = max(ends[-1][1], s["end"])
        else:
            ends.append([s["start"], s["end"], s["kind"]])
    for start, end, kind in ends:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def masked(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, the text with its spans replaced by their kinds; null
    stays null."""

    def make(texts: pa.Array) -> list:
        return [pa.array([None if t is None else mask(t) for t in X.strings(texts)], pa.string())]

    return X.with_columns(df, text_col, make, f"{text_col} string").select(*df.columns)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""PII: patterns propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("iban", "id_number", "local_phone")
#: Score of a span before context; what context words within NEAR characters add; spans below KEEP go,
#: except those of the first four kinds.
START = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "id_number": 0.4, "local_phone": 0.3}
CONTEXT = 0.35
NEAR = 48
KEEP = 0.6

#: Words near a span that speak for its kind.
WORDS = {
    "email": ("mail", "email", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "id_number": ("ssn", "social security", "insurance number", "taxpayer"),
    "local_phone": ("call", "phone", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}

#: A context word stands alone, not inside another one.
_NEAR = {kind: re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)", re.I) for kind, words in WORDS.items()}

#: Lengths of account numbers by country, where they are settled.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(text: str):
    """Spans of account numbers that pass mod-97. What follows one in capitals and digits is left out: of the
    ends at a space or where the text goes on otherwise, the longest that has its country's length and passes."""
    at = 0
    while m := _IBAN.search(text, at):
        at, end = m.start() + 4, m.end()
        if end < len(text) and text[end].isalnum():  # runs on: the last word belongs to something else
            end = text.rfind(" ", m.start(), end)
        length = IBAN_LENGTHS.get(m[0][:2])
        while end > m.start():
            part = text[m.start() : end]
            n = len(part) - part.count(" ")
            if n < 15:
                break
            if (length is None or n == length) and n <= 34 and mod97(part):
                yield m.start(), end
                at = end
                break
            end = text.rfind(" ", m.start(), end)


def _octet(part: str) -> bool:
    part = part.lstrip("0")  # of any length
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str):
    """Leftmost matches of local part, @, dotted domain; in one pass, as @ ends every local part."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four base kinds: leftmost and non-overlapping in each; those that fail a check go."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = list(_emails(text))
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _context(text: str, kind: str, start: int, end: int) -> float:
    """What a context word adds that lies whole within NEAR characters; one more on each side tells where it ends."""
    near, first = _NEAR[kind], max(0, start - NEAR - 1)
    if near.search(text[first:start], start - NEAR - first if start > NEAR else 0):
        return CONTEXT
    after = near.search(text[end : end + NEAR + 1])
    return CONTEXT if after and after.end() <= NEAR else 0.0


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; positions in code points, end exclusive."""
    found = [(k, s, e) for k, spans in base_spans(text).items() for s, e in spans]
    taken = {(s, e) for _, s, e in found}
    if any("0" <= c <= "9" for c in text):
        found += [("iban", s, e) for s, e in _ibans(text)]
        found += [("id_number", *m.span()) for m in _ID.finditer(text)]
        found += [("local_phone", *m.span()) for m in _NUMBER.finditer(text) if m.span() not in taken]
    scored = [(k, s, e, min(1.0, START[k] + _context(text, k, s, e))) for k, s, e in found]
    return [x for x in scored if x[0] in KINDS or x[3] >= KEEP]


def spans(docs: DataFrame) -> DataFrame:
    """Of every row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and scores.

    Counts and base_sha256 cover the base spans; spans lists all of them as kind:start:end. Whole texts
    are searched in time linear in their length, one row at a time, without a shuffle. Null texts count
    as empty. Ids may be null or repeat: each row has its own result. An empty table gives an empty
    result; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                found = find(text or "")
                base = [x for x in found if x[0] in KINDS]
                for k, kind in enumerate(KINDS):
                    cols[k].append(sum(x[0] == kind for x in base))
                cols[4].append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in base).encode()).hexdigest())
                cols[5].append(",".join(f"{k}:{s}:{e}" for k, s, e, _ in found))
                cols[6].append([x[3] for x in found])
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "scores"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, scores array<double>")

"""Personal data: expressions propose spans, checksums confirm them, context words adjust a score.

Base kinds (email, ip, card, phone) are leftmost, non-overlapping matches of fixed expressions
over the whole text; a match that fails its check is dropped without another try, and a base
span always stays. The method adds spans: account numbers (``iban``, of their country's length and
confirmed by mod 97), cards of 13 to 15 digits with an issuer's prefix that pass Luhn, national
numbers (``ssn``), and ``secret``: tokens of known formats, private keys, signed web tokens,
values assigned to names such as password, user:password in URLs, and long hexadecimal numbers.
Each proposal has a prior, by how certain its format is; words within ``WINDOW`` characters raise
or lower it, for each kind its own, and added spans stay from ``THRESHOLD`` on. Of added spans of
a kind that overlap, the longest stays.

Defined results: a null text is empty and has no spans; a null doc_id passes; repeated rows are
each scanned; an empty table gives an empty result; other columns are ignored. Offsets are code
points, ends exclusive. All scans are linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
BASE_KINDS = KINDS[:4]
WINDOW = 48
THRESHOLD = 0.6

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[\x20-]?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SHORT_CARD = re.compile(r"3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|4[0-9]{12}")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"(?i)(?:pass(?:word|wd|phrase)|pwd|secret|token|credential|(?:api|access|auth|private|secret|client)[_-]?key)s?[\"']?[\x20\t]*(?::=|=>|=|:)[\x20\t]*[\"']?([^\s\"'`,;<>(){}\[\]]{8,200})")
_LOGIN = re.compile(r"(?<=://)[^\s/:@]{1,64}:([^\s/:@]{4,128})(?=@[A-Za-z0-9])")

# Formats of access tokens.
TOKENS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,255}",
    r"github_pat_[A-Za-z0-9_]{22,255}",
    r"glpat-[A-Za-z0-9_-]{20}",
    r"xox[abeoprs]-[A-Za-z0-9-]{10,250}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,99}",
    r"SG\.[A-Za-z0-9_-]{16,64}\.[A-Za-z0-9_-]{16,64}",
    r"npm_[A-Za-z0-9]{36}",
    r"pypi-[A-Za-z0-9_-]{50,250}",
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
)
_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(TOKENS) + r")(?![A-Za-z0-9])")
# The last one is tried only where a run of its characters begins, so each run is read once.
# Each format holds one of the first, each assignment one of the second.
_TOKEN_PARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "AIza", "k_live_", "k_test_", "SG.", "npm_", "pypi-", "eyJ")
_ASSIGNED_PARTS = ("pass", "pwd", "secret", "token", "credential", "key")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----(?:[^-]{1,20000}-----END \1-----)?")

# Characters of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

# Words that speak for or against a kind.
CONTEXT = {
    "card": ("card", "credit", "visa", "amex", "payment", "karte", "carte", "tarjeta"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "national", "insurance"),
    "secret": ("token", "secret", "key", "password", "api", "auth", "credential"),
}
AGAINST = {
    "card": ("example", "sample", "test", "isbn", "order", "invoice"),
    "iban": ("example", "sample"),
    "ssn": ("example", "sample", "test", "order", "invoice", "part"),
    "secret": ("sha1", "sha256", "md5", "commit", "checksum", "digest"),
}
#: How certain a format is by itself; a context word moves this by ``MOVE``.
PRIOR = {"card": 0.6, "iban": 0.95, "ssn": 0.4, "token": 0.95, "assigned": 0.7, "hex": 0.4}
MOVE = 0.3
_WORDS = re.compile(r"[a-z0-9]+")


def luhn(digits: str) -> bool:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(doubled[d] for d in back[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each @: the local part reaches back as far as its characters, at most to
    the end of the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ip_ok(found: str) -> bool:
    return all(len(x := part.lstrip("0")) < 3 or len(x) == 3 and x <= "255" for part in found.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m.group())]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def score(kind: str, prior: float, text: str, start: int, end: int) -> float:
    """The prior of a proposal, moved by the words around it."""
    around = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    words = set(_WORDS.findall(around.lower()))
    return prior + MOVE * any(w in words for w in CONTEXT[kind]) - MOVE * any(w in words for w in AGAINST[kind])


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, single blanks or hyphens in between."""
    for m in _IBAN.finditer(text):
        wanted, digits, at = IBAN_LENGTHS.get(m.group()[:2], 0), list(m.group()), m.end()
        while len(digits) < wanted and at < len(text):
            skip = text[at] in " -"
            c = text[at + skip : at + skip + 1]
            if not ("0" <= c <= "9" or "A" <= c <= "Z"):
                break
            digits.append(c)
            at += skip + 1
        ends = not (at < len(text) and text[at].isascii() and text[at].isalnum())
        if len(digits) == wanted and ends and mod97("".join(digits)):
            yield m.start(), at


def proposed_spans(text: str) -> Iterator[tuple[str, float, int, int]]:
    """(kind, prior, start, end) of what the method may add, checksums passed."""
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 15 and _SHORT_CARD.fullmatch(digits) and luhn(digits):
            yield "card", PRIOR["card"], m.start(), m.end()
    for start, end in _accounts(text):
        yield "iban", PRIOR["iban"], start, end
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            yield "secret", PRIOR["token"], m.start(), m.end()
    if any(p in text for p in _TOKEN_PARTS):
        for m in _TOKEN.finditer(text):
            yield "secret", PRIOR["token"], m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "secret", PRIOR["hex"], m.start(), m.end()
    lower = text.lower()
    for m in _ASSIGNED.finditer(text) if any(p in lower for p in _ASSIGNED_PARTS) else ():
        value = m.group(1)
        # Words of prose and placeholders aren't values.
        if any(c.isdigit() for c in value) or (any(not c.isalnum() for c in value[:-1]) and not value.startswith(("$", "%", "*", "http"))):
            yield "secret", PRIOR["assigned"], m.start(1), m.end(1)
    if "://" in text:
        for m in _LOGIN.finditer(text):
            yield "secret", PRIOR["assigned"], m.start(1), m.end(1)
    for m in _SSN.finditer(text) if "-" in text else ():
        yield "ssn", PRIOR["ssn"], m.start(), m.end()


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that the method adds."""
    found: list[tuple[str, int, int]] = []
    sure = {(k, s, e) for k, prior, s, e in proposed_spans(text) if score(k, prior, text, s, e) >= THRESHOLD}
    for kind, start, end in sorted(sure, key=lambda x: (x[0], x[1], -x[2])):
        if found and found[-1][0] == kind and start < found[-1][2]:
            if end - start > found[-1][2] - found[-1][1]:
                found[-1] = (kind, start, end)
        else:
            found.append((kind, start, end))
    return found


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"]
    for batch in batches:
        rows = []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            found = sorted({*base, *added_spans(text)}, key=lambda x: (KINDS.index(x[0]), x[1]))
            counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), len(found) - len(base)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, counts of the base kinds, base_sha256, spans (all), n_added
    (those beyond the base)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first and longest."""
    parts, done = [], 0
    for start, back, kind in sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if start >= done:
            parts += [text[done:start], f"[{kind}]"]
        done = max(done, -back)
    return "".join(parts) + text[done:]

"""Spans in texts: patterns, their checks, and the digests that queries return.  Pure Python, run inside Arrow tasks."""

from __future__ import annotations

import hashlib
import re

# The patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

PRIVATE_KINDS = ("email", "ip", "card", "phone")
SECRET_KINDS = ("assign", "access", "hex")

_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[0-9]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NOT_DIGIT = re.compile("[^0-9]")
#: What an e-mail's local part may consist of, to look for it backwards from an @ sign.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str):
    """As EMAIL.finditer, in time that grows with the text alone: only @ signs are looked at.  A match starts at the
    first local character after the last match, if any stands right before the @."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _AFTER_AT.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def ips(text: str):
    """As IP.finditer, in time that grows with the text alone: of runs of digits joined by dots, each next four are a match
    (from inside a run a search would find the same end)."""
    for m in _DOTTED.finditer(text):
        runs = list(_DIGITS.finditer(text, *m.span()))
        for i in range(0, len(runs) - 3, 4):
            parts = [r.group().lstrip("0") for r in runs[i : i + 4]]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                yield runs[i].start(), runs[i + 3].end()


def cards(text: str):
    for m in CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


def private_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for i, f in ((1, ips), (2, cards), (3, phones)):
            found += [(s, e, i) for s, e in f(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, PRIVATE_KINDS[k]) for s, e, k in found]


def secret_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) by start, then kind as listed."""
    found = [(*m.span(), 0, m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(*m.span(), 1, m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    found += [(*m.span(), 2, m.group()) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, SECRET_KINDS[k], v) for s, e, k, v in found]


def listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, *_ in spans)


def digest(spans) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()

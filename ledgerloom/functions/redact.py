"""Redaction of text: learned values first, then whatever a rule claims; running it twice changes nothing.

A text is read once, from left to right, from sign to sign: a separator (``=`` or ``:``) with a known key before it claims the value behind it; ``://`` claims a
user up to its ``@``; a scheme claims its token, a currency sign its figure, a long digest itself, a dumped environment all that it holds. What is
claimed isn't looked into again, so the work is linear in the text, whatever it holds. Texts without any sign never leave the JVM.
Keys are data: a word, in any case, and the kind of its value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a credential becomes; keys of credentials, of money and of parties; least characters of a learned value, and of a digest.
HIDDEN = "[REDACTED]"
CREDENTIALS = ("secret", "secrets", "password", "passwd", "pwd", "password_hash", "token", "access_token", "session_token", "api_key", "apikey", "api-key", "credential", "credentials", "authorization", "salt", "fingerprint", "token_fingerprint")
MONEY = ("amount", "amount_paise", "gst_paise")
PARTIES = ("vendor", "vendor_id", "party", "supplier", "payee", "subject", "raw_subject", "ledger")
LEAST, DIGEST = 8, 64
CREDENTIAL, AMOUNT, PARTY = "credential", "amount", "party"
KEYS = {k: kind for kind, words in ((CREDENTIAL, CREDENTIALS), (AMOUNT, MONEY), (PARTY, PARTIES)) for k in words}
#: Signs other than separators: each can be left out.
SHAPES = ("environment", "address", "scheme", "digest", "currency")

_MARK = "[REDACTED"
_QUOTES, _STOPS = "\"'", frozenset(",;)]}")
_SIGNS = rf"[=:₹]|(?i:\b(?:bearer|basic|rs|inr)\b)|environ\(\{{|\b[0-9A-Fa-f]{{{DIGEST},}}\b"
_SIGN = re.compile(_SIGNS)
_FIGURE = re.compile(r"-?\d[\d,]*(?:\.\d+)?")
Claim = tuple[int, int, str]


class Reader:
    """One text, and how to read around a place in it."""

    def __init__(self, text: str, keys: Mapping[str, str], shapes: Sequence[str]):
        self.text, self.keys, self.shapes = text, keys, shapes
        self.longest = max(map(len, keys), default=0)
        self.open_ended: set[str] = set()  # closing marks that don't come again

    def past_space(self, at: int) -> int:
        while at < len(self.text) and self.text[at].isspace():
            at += 1
        return at

    def closing(self, mark: str, at: int) -> int:
        """Where ``mark`` comes next; -1 if it doesn't, which is looked up once."""
        if mark in self.open_ended:
            return -1
        end = self.text.find(mark, at)
        if end < 0:
            self.open_ended.add(mark)
        return end

    def key(self, at: int) -> str | None:
        """The known key that ends before the separator at ``at``, with or without a closing quote and space between."""
        end = at
        while end and self.text[end - 1].isspace():
            end -= 1
        if end and self.text[end - 1] in _QUOTES:
            end -= 1
        start = end
        while start and end - start <= self.longest and (self.text[start - 1].isalnum() or self.text[start - 1] in "_-"):
            start -= 1
        parts = self.text[start:end].lower().split("-")
        for k in range(len(parts)):  # a key may stand behind a dash, and may hold one
            word = "-".join(parts[k:])
            if word in self.keys and len(word) <= self.longest:
                return word
        return None

    def value(self, at: int) -> int:
        """The end of the value at ``at``: behind the quote that closes it, or before white space or a sign that ends one."""
        if at < len(self.text) and self.text[at] in _QUOTES:
            end = self.closing(self.text[at], at + 1)
            if end >= 0:
                return end + 1
        end = at
        while end < len(self.text) and self.text[end] not in _STOPS and not self.text[end].isspace():
            end += 1
        return end

    def token(self, at: int) -> tuple[int, int] | None:
        """Where the run behind white space at ``at`` starts and ends."""
        start = self.past_space(at)
        end = start
        while end < len(self.text) and not self.text[end].isspace():
            end += 1
        return (start, end) if start > at and end > start else None

    def keyed(self, at: int) -> Claim | None:
        key = self.key(at)
        if key is None:
            return None
        start, kind = self.past_space(at + 1), self.keys[key]
        if kind == AMOUNT:
            figure = _FIGURE.match(self.text, start)
            return (start, figure.end(), f"{_MARK} amount]") if figure else None
        end = self.value(start)
        found = self.text[start:end]
        bare = found.strip(_QUOTES)
        if end == start or bare.startswith(_MARK):
            return None
        if kind == PARTY:
            return start, end, f"{_MARK} {key} len={len(bare)}]"
        token = self.token(end) if bare.lower() in ("bearer", "basic") else None
        return (start, token[1], f"{HIDDEN}{self.text[end : token[0]]}{HIDDEN}") if token else (start, end, HIDDEN)

    def address(self, at: int) -> Claim | None:
        start = end = at + 3
        while end < len(self.text) and self.text[end] not in "/@" and not self.text[end].isspace():
            end += 1
        return (start, end, HIDDEN) if start < end < len(self.text) and self.text[end] == "@" else None

    def figure(self, at: int, apart: bool) -> Claim | None:
        """A figure behind a currency's sign; some signs have to stand ``apart`` from it."""
        start = self.past_space(at)
        figure = _FIGURE.match(self.text, start) if start > at or not apart else None
        return (start, figure.end(), f"{_MARK} amount]") if figure and figure[0][0] != "-" else None

    def claim(self, at: int, sign: str) -> Claim | None:
        shapes, low = self.shapes, sign.lower()
        if sign == ":" and self.text.startswith("://", at):
            return self.address(at) if "address" in shapes else None
        if sign in "=:":
            return self.keyed(at)
        if low in ("bearer", "basic"):
            token = self.token(at + len(sign)) if "scheme" in shapes else None
            return (*token, HIDDEN) if token and not self.text.startswith(_MARK, token[0]) else None
        if low in ("₹", "rs", "inr"):
            dot = low == "rs" and self.text.startswith(".", at + 2)
            found = self.figure(at + len(sign) + dot, low == "inr") if "currency" in shapes else None
            return found and (at, *found[1:])
        if low.startswith("environ"):
            end = self.closing("})", at) if "environment" in shapes else -1
            return (at + len("environ("), end + 1, f"{_MARK} environment]") if end >= 0 else None
        return (at, at + len(sign), HIDDEN) if "digest" in shapes else None

    def claims(self) -> Iterator[Claim]:
        done = 0
        for sign in _SIGN.finditer(self.text):
            if sign.start() >= done and (found := self.claim(sign.start(), sign[0])):
                yield found
                done = found[1]


def redact(text: str, keys: Mapping[str, str] = KEYS, shapes: Sequence[str] = SHAPES) -> str:
    """The text with a mark for each claim."""
    out, at = [], 0
    for start, end, mark in Reader(text, keys, shapes).claims():
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]]) if out else text


def redacted(text: Column, learned: dict[str, str] | None = None, keys: Mapping[str, str] = KEYS, shapes: Sequence[str] = SHAPES) -> Column:
    """``learned``: value to label (empty: a credential), at least LEAST characters each; longer ones go first. Null stays null."""
    for value, label in sorted((learned or {}).items(), key=lambda x: (-len(x[0]), x[0])):
        if len(value) >= LEAST:
            text = F.replace(text, F.lit(value), F.lit(f"{_MARK} {label} len={len(value)}]" if label else HIDDEN))
    own = {k.lower(): kind for k, kind in keys.items()}

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, own, shapes), na_action="ignore")

    signed = text.rlike(_SIGNS)
    return F.coalesce(read(F.when(signed, text)), text)

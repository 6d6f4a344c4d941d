"""Tokens: kinds, values and the bookkeeping of where their text came from.

A token's ``original`` is the piece of input behind it, leading white space
included, and ``spans`` has for each character of ``txt`` its place in
``original``. Most tokens are an untouched end of their original; their spans
are ``None`` and are worked out when asked for.
"""

from __future__ import annotations

import enum
from typing import Any


class Kind(enum.IntEnum):
    __hash__ = int.__hash__  # kinds are looked up for every token; Enum's own hash is that of the name, by Python code

    RAW = -1
    PUNCTUATION = 1
    TIME = 2
    DATE = 3
    YEAR = 4
    NUMBER = 5
    WORD = 6
    TELNO = 7
    PERCENT = 8
    URL = 9
    ORDINAL = 10
    TIMESTAMP = 11
    CURRENCY = 12
    AMOUNT = 13
    PERSON = 14
    EMAIL = 15
    ENTITY = 16
    UNKNOWN = 17
    DATEABS = 18
    DATEREL = 19
    TIMESTAMPABS = 20
    TIMESTAMPREL = 21
    MEASUREMENT = 22
    NUMWLETTER = 23
    DOMAIN = 24
    HASHTAG = 25
    MOLECULE = 26
    SSN = 27
    USERNAME = 28
    SERIALNUMBER = 29
    COMPANY = 30
    S_SPLIT = 10000
    P_BEGIN = 10001
    P_END = 10002
    S_BEGIN = 11001
    S_END = 11002
    X_END = 12001


#: Names of kinds that differ from the constant's.
_NAMES = {Kind.S_BEGIN: "BEGIN SENT", Kind.S_END: "END SENT", Kind.P_BEGIN: "BEGIN PARA", Kind.P_END: "END PARA", Kind.S_SPLIT: "SPLIT SENT"}
ENDS = frozenset((Kind.P_END, Kind.S_END, Kind.X_END, Kind.S_SPLIT))
BEGINS = frozenset((Kind.P_BEGIN, Kind.S_BEGIN))
TEXTS = frozenset((Kind.WORD, Kind.PERSON, Kind.ENTITY, Kind.MOLECULE, Kind.COMPANY))
#: What a token that isn't punctuation shows as its normal form in comparisons.
NO_MARK = "�"


_SHOWN = {int(k): _NAMES.get(k, k.name) for k in Kind}


def kind_name(kind: int) -> str:
    return _SHOWN[kind]


class Token:
    """One token. ``val`` depends on the kind, as the table in the README says."""

    __slots__ = ("kind", "original", "spans_", "txt", "val")

    def __init__(self, kind: int, txt: str = "", val: Any = None, original: str | None = None, spans: list[int] | None = None) -> None:
        self.kind, self.txt, self.val, self.original, self.spans_ = kind, txt or "", val, original, spans

    @property
    def spans(self) -> list[int] | None:
        if self.spans_ is None and self.original is not None:
            lead = len(self.original) - len(self.txt)
            return list(range(lead, lead + len(self.txt)))
        return self.spans_

    @property
    def mark(self) -> str:
        """The normal form of punctuation."""
        return self.val[1] if self.kind == Kind.PUNCTUATION else NO_MARK

    @property
    def number(self) -> float:
        if self.kind == Kind.YEAR:
            return float(self.val)
        if self.kind == Kind.NUMBER:
            return self.val
        raise ValueError("not a number or a year")

    @property
    def integer(self) -> int:
        return int(self.number)

    @property
    def ordinal(self) -> int:
        return self.val if self.kind == Kind.ORDINAL else int(self.number)

    @property
    def meanings(self) -> list:
        return list(self.val or ()) if self.kind == Kind.WORD else []

    def as_tuple(self) -> tuple:
        return self.kind, self.txt, self.val

    def equal(self, other: Token) -> bool:
        """Equality of content, wherever it came from."""
        return self.as_tuple() == other.as_tuple()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Token) and self.equal(other) and self.original == other.original and self.spans == other.spans

    __hash__ = None  # type: ignore[assignment]

    def __getitem__(self, i: int) -> Any:
        return self.as_tuple()[i]

    def __repr__(self) -> str:
        return f"Token({self.kind}, {self.txt!r}, {self.val!r}, {self.original!r}, {self.spans})"

    def as_kind(self, kind: int, val: Any = None) -> Token:
        return Token(kind, self.txt, val, self.original, self.spans_)

    def cut(self, at: int) -> tuple[Token, Token]:
        """The first ``at`` characters, and the rest; from the end if negative.

        A cut at or beyond the end leaves an empty rest, and the first part keeps
        the whole original.
        """
        spans = self.spans
        if spans is None:
            return Token(self.kind, self.txt[:at], self.val), Token(self.kind, self.txt[at:], self.val)
        if at >= len(spans):
            return Token(self.kind, self.txt, self.val, self.original, spans), Token(self.kind, "", None, "", [])
        place = spans[at]
        left = Token(self.kind, self.txt[:at], self.val, self.original[:place], spans[:at])
        return left, Token(self.kind, self.txt[at:], self.val, self.original[place:], [s - place for s in spans[at:]])

    def replaced(self, start: int, end: int, new: str) -> Token:
        """With ``new``, of one character or none, for a part of the text."""
        spans = self.spans
        if spans is not None:
            spans = spans[: start + len(new)] + spans[end:]
        return Token(self.kind, self.txt[:start] + new + self.txt[end:], self.val, self.original, spans)

    def replaced_all(self, old: str, new: str) -> Token:
        token, at = self, 0
        while (at := token.txt.find(old)) >= 0:
            token = token.replaced(at, at + len(old), new)
        return token

    def replaced_longer(self, start: int, end: int, new: str) -> Token:
        """With ``new``, of any length; its characters have no place of their own in the original."""
        spans = self.spans
        if spans is not None:
            place = spans[end] if end < len(spans) else len(self.original)
            spans = spans[:start] + [place] * len(new) + spans[end:]
        return Token(self.kind, self.txt[:start] + new + self.txt[end:], self.val, self.original, spans)

    def joined(self, other: Token, separator: str = "", later: bool = False) -> Token:
        """Both as one token, with the kind and value of the first, or of the later one."""
        first, second = self.original or "", other.original or ""
        mine, theirs = self.spans or [], other.spans or []
        between = [len(first)] * len(separator) if theirs else []
        spans = mine + between + [s + len(first) for s in theirs]
        main = other if later else self
        return Token(main.kind, self.txt + separator + other.txt, main.val, first + second, spans)


class Inert(Token):
    """A word that no rule can touch. One object stands for all its places in all texts, so it is never changed."""

    __slots__ = ()


def spacing_class(mark: str) -> int:
    """TP_LEFT and so on, of a punctuation mark."""
    from ..constants import CENTER_PUNCTUATION, LEFT_PUNCTUATION, NONE_PUNCTUATION, RIGHT_PUNCTUATION, TP_CENTER, TP_LEFT, TP_NONE, TP_RIGHT

    for marks, tp in ((LEFT_PUNCTUATION, TP_LEFT), (RIGHT_PUNCTUATION, TP_RIGHT), (NONE_PUNCTUATION, TP_NONE), (CENTER_PUNCTUATION, TP_CENTER)):
        if mark and mark in marks:
            return tp
    return TP_CENTER

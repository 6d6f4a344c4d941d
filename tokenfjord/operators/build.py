"""Tokens made by hand, and a sequence of tokens with a view ahead."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from .. import constants as C
from .cascade import may_end
from .tokens import Kind, Token, spacing_class

#: Kinds whose value is given as it is, as a tuple of parts, or not at all.
_ONE = {Kind.YEAR, Kind.NUMBER, Kind.PERCENT, Kind.ORDINAL, Kind.CURRENCY, Kind.USERNAME, Kind.PERSON, Kind.WORD}
_PARTS = {Kind.TIME: 3, Kind.DATE: 3, Kind.DATEABS: 3, Kind.DATEREL: 3, Kind.TIMESTAMP: 6, Kind.TIMESTAMPABS: 6, Kind.TIMESTAMPREL: 6, Kind.AMOUNT: 2, Kind.MEASUREMENT: 2, Kind.NUMWLETTER: 2}


def make(kind: Kind, text: str | Token = "", *value: Any) -> Token:
    """A token of a kind from a text, or from a token whose origin is kept.

    ``make(Kind.TIME, "13:45", 13, 45, 0)``, ``make(Kind.TELNO, "5254764",
    "525-4764")``, ``make(Kind.PUNCTUATION, "...", "…")``.
    """
    token = text if isinstance(text, Token) else Token(kind, text)
    val: Any = None
    if kind == Kind.PUNCTUATION:
        normal = value[0] if value else token.txt
        val = (spacing_class(normal) if len(normal) == 1 else C.TP_CENTER, normal)
    elif kind == Kind.TELNO:
        val = (value[0], value[1] if len(value) > 1 else "354")
    elif kind in _PARTS:
        if len(value) != _PARTS[kind]:
            raise ValueError(f"{kind.name} takes {_PARTS[kind]} values")
        val = tuple(value)
    elif kind in _ONE:
        val = value[0] if value else None
    return token.as_kind(kind, val)


class TokenStream:
    """An iterator of tokens that shows those to come: ``stream[0]`` is the next one."""

    def __init__(self, tokens: Iterable[Token], lookahead: int = 2) -> None:
        self._rest, self._seen, self.lookahead = iter(tokens), deque(), lookahead

    def __iter__(self) -> Iterator[Token]:
        return self

    def __next__(self) -> Token:
        return self._seen.popleft() if self._seen else next(self._rest)

    def __getitem__(self, place: int) -> Token | None:
        if not 0 <= place < self.lookahead:
            raise IndexError("beyond the view ahead")
        while len(self._seen) <= place:
            token = next(self._rest, None)
            if token is None:
                return None
            self._seen.append(token)
        return self._seen[place]

    def view(self, read: Callable[[Token], Any], place: int = 0, default: Any = None) -> Any:
        """What ``read`` gives for the token at a place, or the default beyond the end."""
        token = self[place]
        return default if token is None else read(token)

    def could_be_end_of_sentence(self, place: int = 0, multiplier: bool = False) -> bool:
        return self.view(lambda t: may_end(t, multiplier), place, False)

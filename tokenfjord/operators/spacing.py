"""Running text from tokens, and text with its spaces put right."""

from __future__ import annotations

import re
from collections.abc import Iterable

from .. import constants as C
from .engine import shown
from .tokens import Kind, Token, spacing_class

_NUMBER = r"[+\-$€]?\d"
_LETTER = r"[^\W\d_]"
_PARTS = re.compile(
    "|".join(
        (
            rf"{_NUMBER}{{1,3}}(?:\.\d\d\d)+,\d+",
            rf"{_NUMBER}{{1,3}}(?:,\d\d\d)+\.\d+",
            rf"{_NUMBER}+,\d+(?!\.\d)",
            rf"{_NUMBER}+\.\d+(?!,\d)",
            rf"{_LETTER}+\.(?:{_LETTER}+\.)+(?!{_LETTER}+\s)",
            r"°[CF]",
            r"--+|––+|——+",
            rf"[~\s{re.escape(C.PUNCTUATION)}]",
        )
    )
)


def spaced(last: int, this: int) -> bool:
    return this in C.SPACE_BEFORE[last]


def detokenize(tokens: Iterable[Token], normalize: bool = False) -> str:
    """The tokens as running text; straight double quotes open and close in turn."""
    out: list[str] = []
    last, before, quotes = C.TP_NONE, None, 0
    for t in tokens:
        text = shown(t, normalize=True) if normalize else t.txt
        if not text:
            before = None
            quotes = 0 if t.kind == Kind.S_END else quotes
            continue
        this = C.TP_WORD
        if t.kind == Kind.PUNCTUATION and len(text) == 1:
            if text == '"':
                this = C.TP_RIGHT if quotes % 2 else C.TP_LEFT
                quotes += 1
            elif text in C.JOINING_HYPHENS and before == Kind.WORD and (t.original or "").startswith(" "):
                this = C.TP_CENTER
            elif text in C.PUNCTUATION:
                this = spacing_class(text)
        out.append(" " + text if out and spaced(last, this) else text)
        last, before = this, t.kind
    return "".join(out)


def _pieces(text: str) -> Iterable[str]:
    at = 0
    for m in _PARTS.finditer(text):
        if m.start() > at:
            yield text[at : m.start()]
        yield m[0]
        at = m.end()
    yield text[at:]


def correct_spaces(text: str) -> str:
    """The text with the spaces between its words and marks put right."""
    out: list[str] = []
    last, quotes, word, gap = C.TP_NONE, 0, "", False
    for piece in _pieces(text):
        w = piece.strip()
        if not w:
            gap = gap or bool(piece)
            continue
        after, word = word, ""
        if len(w) > 1:
            this, word = C.TP_WORD, w.lower() if w.isalpha() else ""
        elif w == '"':
            this = C.TP_RIGHT if quotes % 2 else C.TP_LEFT
            quotes += 1
        elif w in C.PUNCTUATION:
            this = spacing_class(w)
            if w in C.JOINING_HYPHENS and gap and after and after not in ("og", "eða"):
                this = C.TP_CENTER
        else:
            this, word = C.TP_WORD, w.lower()
        gap = False
        hyphen = len(out) >= 2 and out[-1] in C.JOINING_HYPHENS
        before = out[-2].lstrip() if len(out) >= 2 else ""
        if hyphen and w in ("og", "eða") and before.isalpha():
            out.append(" " + w)
        elif hyphen and this == C.TP_WORD and w.isalpha() and (out[-2] == "," or before in ("og", "eða")):
            out[-1] = " " + out[-1]
            out.append(w)
        else:
            clock = w.isnumeric() and len(w) == 2 and len(out) >= 2 and out[-1] == ":" and before.strip().isnumeric() and len(before.strip()) <= 2
            out.append(" " + w if out and spaced(last, this) and not clock else w)
        last = this
    return "".join(out)

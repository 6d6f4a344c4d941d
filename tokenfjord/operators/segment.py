"""From chunks of text to raw tokens and the marks of breaks between them."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

from .. import constants as C
from .tokens import Kind, Token

_ROUGH = re.compile(r"\s*\S+|\s+")
_HARD_BREAK = re.compile(r"(\n\s*\n|^\s+$|\]\]\[\[)")
_LINE_BREAK = re.compile(r"(\n)")
_ZERO_WIDTH = re.compile(f"[{C.ZERO_WIDTH}]")
_COMPOSED = re.compile("|".join(C.COMPOSED))
_HTML = re.compile(C.HTML_PATTERN)
_SEEN = re.compile(f"[{C.ZERO_WIDTH}{C.ACUTE}{C.DIAERESIS}]")
#: A text without these has no breaks, no paragraph marks and nothing to rewrite.
_MARKED = re.compile(rf"[\n\[\]&{C.ZERO_WIDTH}{C.ACUTE}{C.DIAERESIS}]")


def html_character(m: re.Match) -> str:
    """What an escape stands for; a code point that doesn't exist stays as it is."""
    if m[3] is not None:
        return C.HTML_NAMES[m[3]]
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if code < 0x110000 else m[0]


def _rewritten(token: Token, pattern: re.Pattern, new) -> Token:  # noqa: ANN001
    shift = 0
    for m in pattern.finditer(token.txt):
        put = new(m)
        if put != m[0]:
            token = token.replaced(m.start() - shift, m.end() - shift, put)
            shift += m.end() - m.start() - len(put)
    return token


def normalised(token: Token, compose: bool = True, html: bool = False) -> Token:
    """Without zero-width characters, with composed vowels and, if asked for, HTML escapes resolved."""
    if _SEEN.search(token.txt):
        token = _rewritten(token, _ZERO_WIDTH, lambda m: "")
        if compose:
            token = _rewritten(token, _COMPOSED, lambda m: C.COMPOSED[m[0]])
    if html and "&" in token.txt:
        token = _rewritten(token, _HTML, html_character)
    return token


def _words(token: Token) -> Iterator[Token]:
    """The parts between white space, each with the white space before it in its original only."""
    if token.spans_ is None:  # untouched: at most one word
        text = token.txt.lstrip()
        yield Token(Kind.RAW, text, None, token.original) if text else Token(Kind.RAW, "", None, token.original, [])
        return
    rest = token
    while rest.txt:
        m = _ROUGH.match(rest.txt)
        part, rest = rest.cut(m.end())
        yield part.replaced(0, len(part.txt) - len(part.txt.lstrip()), "")


def raw_tokens(chunks: str | Iterable[str], compose: bool = True, html: bool = False, line_sentences: bool = False) -> Iterator[Token]:
    """Raw tokens, and S_SPLIT, P_BEGIN and P_END marks.

    An empty chunk is a break. White space at the end of a chunk goes before
    the next word, or into a last S_SPLIT.
    """
    return itertools.chain.from_iterable(parts(chunks, lambda raw: (raw,), lambda original: (Token(Kind.RAW, original.lstrip(), None, original),), compose, html, line_sentences))


def parts(chunks: str | Iterable[str], lexed: Callable[[Token], Iterable[Token]], known: Callable[[str], Iterable[Token]], compose: bool = True, html: bool = False, line_sentences: bool = False) -> Iterator[Iterable[Token]]:
    """The marks, and what ``lexed`` makes of a raw token, or ``known`` of the original of an untouched one."""
    if isinstance(chunks, str):
        if not _MARKED.search(chunks):
            rough = _ROUGH.findall(chunks)
            if rough and not rough[-1].isspace():
                yield itertools.chain.from_iterable(map(known, rough))
                return
        chunks = [chunks] if chunks else []
    saved: Token | None = None
    for chunk in chunks:
        if not chunk and not line_sentences:
            yield (saved.as_kind(Kind.S_SPLIT) if saved else Token(Kind.S_SPLIT),)
            saved = None
            continue
        if saved is not None:
            chunk, saved = (saved.original or "") + chunk, None
        for k, part in enumerate((_LINE_BREAK if line_sentences else _HARD_BREAK).split(chunk)):
            if k % 2:
                if part == "]][[":
                    yield Token(Kind.P_END), Token(Kind.P_BEGIN)
                else:
                    yield (Token(Kind.S_SPLIT, "", None, part, []),)
                continue
            closing = 0
            if not line_sentences:
                while part.startswith("[["):
                    yield (Token(Kind.P_BEGIN),)
                    part = part[2:]
                while part.endswith("]]"):
                    closing += 1
                    part = part[:-2]
            if not _SEEN.search(part) and not (html and "&" in part):  # nothing to rewrite
                rough = _ROUGH.findall(part)
                blank = rough.pop() if rough and rough[-1].isspace() else None
                if saved is not None and rough:
                    yield lexed(saved.joined(Token(Kind.RAW, rough[0].lstrip(), None, rough[0])))
                    saved = None
                    del rough[0]
                yield itertools.chain.from_iterable(map(known, rough))
                if blank:
                    saved = Token(Kind.RAW, "", None, blank, [])
                part = ""
            for m in _ROUGH.finditer(part):
                token = normalised(Token(Kind.RAW, m[0], None, m[0]), compose, html)
                if not token.txt:  # nothing but removed characters
                    continue
                for word in _words(token):
                    if not word.txt:
                        saved = word
                        continue
                    if saved is not None:
                        word, saved = saved.joined(word), None
                    yield lexed(word)
            for _ in range(closing):
                yield (Token(Kind.P_END),)
    if saved is not None:
        yield (saved.as_kind(Kind.S_SPLIT),)


def mark_paragraphs(text: str) -> str:
    """Each non-empty line between paragraph marks."""
    return "[[" + "]][[".join(filter(None, text.split("\n"))) + "]]"

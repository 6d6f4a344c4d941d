"""The engine on fixed inputs, its invariants, and token operations."""

import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenfjord import __main__ as command
from tokenfjord.operators import abbreviations, build, engine, frames, spacing
from tokenfjord.operators.tokens import Kind, Token
from tokenfjord.plans import fixtures


def shown(text, **options):
    return [(t.kind, t.txt, t.val) for t in engine.tokenize(text, **options) if t.txt]


@pytest.mark.parametrize(("case", "text", "want"), fixtures.TOKENS)
def test_tokens(case, text, want):
    assert " + ".join(f"{Kind(k).name}:{x}" for k, x, _ in shown(text)) == want


@pytest.mark.parametrize(("case", "text", "want"), fixtures.KINDS)
def test_kinds(case, text, want):
    assert [t.kind for t in engine.tokenize(text)] == [Kind[fixtures.LETTERS[x]] for x in want.split()]


@pytest.mark.parametrize(("case", "text", "want"), fixtures.NORMAL)
def test_normal_forms(case, text, want):
    assert engine.normalized_text_from_tokens(engine.tokenize(text)) == want


@pytest.mark.parametrize(("case", "text", "want"), fixtures.SPACES)
def test_spaces(case, text, want):
    assert spacing.correct_spaces(text) == want


@pytest.mark.parametrize(("case", "text", "want"), fixtures.SENTENCES)
def test_sentences(case, text, want):
    assert " | ".join(engine.split_into_sentences(text)) == want


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("Klukkan 16:20", (16, 20, 0)),
        ("hálfníu", (8, 30, 0)),
        ("hálfeitt", (12, 30, 0)),
        ("klukkan hálftíu", (9, 30, 0)),
        ("kl. 99", (99, 0, 0)),
        ("mars 1975", (1975, 3, 0)),
        ("Fimmta apríl árið 63 f.Kr.", (-63, 4, 0)),
        ("490 f.Kr.", -490),
        ("3.156,78", 3156.78),
        ("3,156.78", 3156.78),
        ("1/4", 0.25),
        ("2⅞", 2.875),
        ("8 m.kr", (8e6, "ISK")),
        ("¥1874", (1874.0, "JPY")),
        ("ISK 731", (731, "ISK")),
        ("kr. 7.250", (7250, "ISK")),
        ("5550123", ("555-0123", "354")),
        ("240m", ("m", 240.0)),
        ("250 MW", ("W", 250e6)),
        ("18,2°C", ("K", 18.2 + 273.15)),
        ("50° F", ("K", (50 + 459.67) * 5 / 9)),
        ("5 ‰", 0.5),
        ("1874c", (1874, "c")),
        ("3/9/1988 kl. 07:08:09", (1988, 9, 3, 7, 8, 9)),
        ("@a_b.c", "a_b.c"),
    ],
)
def test_values(text, value):
    assert shown(text)[-1][2] == value


def test_options():
    assert shown("$2,650.75", convert_numbers=True) == [(Kind.AMOUNT, "$2.650,75", (2650.75, "USD"))]
    assert shown("4,75prósent", coalesce_percent=True) == [(Kind.PERCENT, "4,75 prósent", 4.75)]
    assert shown("50° F", convert_measurements=True)[0][1] == "50 °F"
    assert shown("&aacute;b&nbsp;c", replace_html_escapes=True)[0][1] == "áb"
    assert shown("Hákon")[0][1] == "Hákon" and shown("Hákon", replace_composite_glyphs=False)[0][1] == "Hákon"
    assert len(engine.split_into_sentences("a\nb", one_sent_per_line=True)) == 2
    assert shown("x", no_such_option=True)


def test_abbreviations_keep_their_meanings():
    assert shown("t.d.")[0][2] == [("til dæmis", 0, "ao", "frasi", "t.d.", "-")]
    assert [m[0] for m in shown("dags. 10/7")[0][2]] == ["dagsetja", "dagsettur"]
    known = abbreviations.Abbreviations('[abbreviations]\na.b.c.* = "x" kk # note\nhm! = "y"\n'.replace("hm!", "hm.!"))
    assert known.meanings("ab.c.")[0][0] == "x" and known.meanings("abc")[0][4] == "abc" and "hm." in known.not_finishers
    assert known.takes_dot("a.b") and known.has_abbreviation("x") and known.meanings("hm")
    for bad in ("[x]\n", 'a = "b"\n', "[abbreviations]\na*\n", '[abbreviations]\nab* = "c"\n', "[not_abbreviations]\nab\n"):
        with pytest.raises(abbreviations.ConfigError):
            abbreviations.Abbreviations(bad)


def test_dictionary_from_a_path(tmp_path):
    path = tmp_path / "own.conf"
    path.write_text('[abbreviations]\nxyz. = "þrír stafir" kk\n', encoding="utf-8")
    assert shown("xyz. er hér", abbreviations=str(path))[0] == (Kind.WORD, "xyz.", [("þrír stafir", 0, "kk", "skst", "xyz.", "-")])


def test_origins():
    tokens = engine.tokenize("uv&#x62;t&eacute;r&#98;c", replace_html_escapes=True)
    assert (tokens[1].txt, tokens[1].spans) == ("uvbtérbc", [0, 1, 2, 8, 9, 17, 18, 23])
    raw = list(engine.engine(engine.Options(replace_html_escapes=True)).raw("Við&nbsp; komum seint."))
    assert [t.original for t in raw] == ["Við", "&nbsp; komum", " seint."]
    assert [t.spans for t in raw] == [[0, 1, 2], [7, 8, 9, 10, 11], [1, 2, 3, 4, 5, 6]]
    assert engine.calculate_indexes(engine.parse_tokens("Æ kál."), last_is_end=True) == ([0, 1, 5, 6, 6], [0, 2, 7, 8, 8])
    text = "[[Fyrri hlutinn.]][[]][[Seinni hlutinn.]]"
    assert "".join(t.original or "" for t in engine.tokenize("Bóka- og blaðasala.")) == "Bóka- og blaðasala."
    assert [t.kind for t in engine.tokenize(text)].count(Kind.P_BEGIN) == 2


def test_token_operations():
    token = Token(Kind.RAW, "axb", None, "  a&123b", [2, 3, 7])
    left, right = token.cut(1)
    assert (left.txt, left.original, left.spans) == ("a", "  a", [2])
    assert (right.txt, right.original, right.spans) == ("xb", "&123b", [0, 4])
    assert token.cut(-1)[1].txt == "b" and token.cut(9)[1].original == ""
    both = left.joined(right, "--")
    assert (both.txt, both.original, both.spans) == ("a--xb", "  a&123b", [2, 3, 3, 3, 7])
    assert token.replaced(1, 2, "").spans == [2, 7] and token.replaced_longer(1, 2, "yyy").spans == [2, 7, 7, 7, 7]
    assert token.replaced_all("x", "").txt == "ab" and token.equal(Token(Kind.RAW, "axb")) and token != Token(Kind.RAW, "axb")
    with pytest.raises(ValueError):
        _ = token.number


def test_chunks():
    chunks = ["…og bíllinn \n ók norður í ", "Skagafjörð\n \t  \nHestarnir biðu \nvið girðinguna", "", "Hundurinn gelti á ", "ketti í\nhlöðunni\n\n\nVeðrið var gott allan daginn"]
    assert len(engine.split_into_sentences(chunks)) == 4
    assert engine.split_into_sentences("") == []


def test_paragraphs():
    found = engine.paragraphs(engine.tokenize("[[Ein. Tvær.]][[...]][[Þrjár.]]"))
    assert [[b for b, _ in p] for p in found] == [[1, 5], [16]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abÁí 1230.,-–:/%°$€@#!?\"'„“()[]\n­́&;klmKr…", max_size=40))
def test_any_text(text):
    tokens = engine.tokenize(text)
    visible = [c for c in text if not c.isspace() and c not in "[]­"]
    kept = [c for t in tokens for c in (t.original or "") if not c.isspace() and c not in "[]­"]
    assert kept == visible
    depth = 0
    for t in tokens:
        depth += (t.kind == Kind.S_BEGIN) - (t.kind == Kind.S_END)
        assert depth in (0, 1) and (t.spans is None or not t.txt or len(t.spans) in (len(t.txt), len(t.txt) - 1))
    assert depth == 0
    spacing.detokenize(tokens)
    spacing.correct_spaces(text)


def run(monkeypatch, capsys, args, text):
    monkeypatch.setattr("sys.stdin", io.StringIO(text))
    command.main(args)
    return capsys.readouterr().out.strip("\n")


def test_command(monkeypatch, capsys):
    text = "Leikurinn fór fram 9. júlí og 250 gestir komu."
    lines = run(monkeypatch, capsys, ["--json"], text).split("\n")
    assert lines[4] == '{"k":"DATEREL","t":"9. júlí","v":[0,7,9],"o":" 9. júlí","s":[1,2,3,4,5,6,7]}'
    lines = run(monkeypatch, capsys, ["--csv"], text).split("\n")
    assert lines[3] == '19,"9. júlí","0|7|9"," 9. júlí","1-2-3-4-5-6-7"' and lines[-1] == '0,"","","",""'
    two = "Afi las blaðið í gær. Svo sofnaði hann í stólnum."
    assert run(monkeypatch, capsys, ["--original"], two) == "Afi las blaðið í gær.\n Svo sofnaði hann í stólnum."
    quoted = "'Nú er nóg komið,' sagði amma, \"Ég fer - og kem ekki aftur.\""
    assert run(monkeypatch, capsys, ["--normalize"], quoted) == "‚ Nú er nóg komið , ‘ sagði amma , „ Ég fer - og kem ekki aftur . “"
    assert run(monkeypatch, capsys, ["-c"], "Miðinn kostaði 3,500.5 USD alls.") == "Miðinn kostaði 3.500,5 USD alls ."
    assert run(monkeypatch, capsys, ["-e"], "Amma f&oacute;r &iacute; sund") == "Amma fór í sund"


def test_csv_values():
    lines = list(frames.output_lines(engine.tokenize('"$25" 0 EUR. 7 er 555-0123'), "csv"))
    assert any(line.startswith('13,"$25","25|USD"') for line in lines) and any(line.startswith('5,"0",""') for line in lines)
    assert any(line.startswith('7,"555-0123","555-0123|354"') for line in lines) and any(line.startswith('12,"EUR.",EUR,') for line in lines)


def test_repeated_runs_agree():
    words = ["kl.", "13:45", "og", "fjármála-", "Jón", "3.", "maí", "2010", "%", "t.d.", "km", "14", "!", '"', "?"]
    draw = random.Random(4)
    for _ in range(200):
        text = " ".join(draw.choices(words, k=12))
        assert shown(text) == shown(text)


def test_tokens_made_by_hand():
    assert build.make(Kind.PUNCTUATION, "...", "…").val == (3, "…") and build.make(Kind.TELNO, "5550123", "555-0123").val == ("555-0123", "354")
    assert build.make(Kind.TIME, "13:45", 13, 45, 0).val == (13, 45, 0) and build.make(Kind.URL, "x").val is None
    kept = build.make(Kind.YEAR, Token(Kind.RAW, "1999", None, " 1999"), 1999)
    assert (kept.val, kept.spans) == (1999, [1, 2, 3, 4])
    with pytest.raises(ValueError):
        build.make(Kind.DATE, "x", 1)


def test_view_ahead():
    stream = build.TokenStream(engine.tokenize("Hann kom."))
    assert next(stream).kind == Kind.S_BEGIN and stream[0].txt == "Hann" and stream[1].txt == "kom"
    assert stream.could_be_end_of_sentence() and not stream.could_be_end_of_sentence(1)
    assert [t.txt for t in stream] == ["Hann", "kom", ".", ""] and stream[0] is None and stream.view(lambda t: t.txt, 0, "-") == "-"
    with pytest.raises(IndexError):
        stream[2]

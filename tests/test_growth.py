"""What the queries do for each row, so that their time grows no faster than their input."""

import random
import uuid
from collections import Counter

import pyarrow as pa
import pytest

from tokenfjord.operators import cascade, engine, frames, lexer, segment
from tokenfjord.operators.tokens import Inert, Kind, kind_name
from tokenfjord.plans import queries as plans
from tokenfjord.plans import rules

QUERIES = plans.QUERIES | rules.QUERIES


def plan(query, spark, tiny):
    return QUERIES[query](spark, tiny)._jdf.queryExecution().executedPlan().toString()


def test_figures_try_the_rules_that_fit_their_shape_only():
    """numbers_english"""
    draw = random.Random(3)
    assert len(lexer._rules_for("23,456.78", 0)) < 4
    for _ in range(4000):
        text = "".join(draw.choice("0123456789" * 3 + ".,:/-+½mkg€% ") for _ in range(draw.randint(1, 12)))
        for convert in (False, True):
            matches = ((p.match(text), rule) for p, rule in lexer.NUMBER_RULES)
            tried = ((m[0], found) for m, rule in matches if m and (found := rule(m, convert)))
            want = next(tried, None)
            got = lexer.number(text, 0, convert)
            assert (got.size, got.kind, got.val) == ((len(want[0]), want[1][0], want[1][1]) if want else (len(text), Kind.UNKNOWN, None))


def test_no_phase_runs_where_no_rule_can_begin(monkeypatch):
    """numbers_icelandic"""
    want = [(t.kind, t.txt, t.val) for t in engine.tokenize("Talan 23.456,78 er rétt. Hún er 5.")]
    monkeypatch.setattr(cascade, "run", None)
    found = engine.Engine().tokenize("Talan 23.456,78 er rétt.")
    assert [(t.kind, t.txt, t.val) for t in found] == [*want[:6], (Kind.S_END, "", None)]
    assert [(t.kind, t.val) for t in engine.Engine().of_kinds("Talan 23.456,78 er rétt.", frozenset([Kind.NUMBER]))] == [(Kind.NUMBER, 23456.78)]


@pytest.mark.parametrize("kind", [Kind.NUMBER, Kind.YEAR, Kind.ORDINAL, Kind.WORD, Kind.PUNCTUATION, Kind.DATEREL])
def test_tokens_of_a_kind_are_those_of_the_whole(kind):
    for text in ("Talan 5 er rétt", "5. maí 1990", "Hér er 1.\n\n2. grein, 1990.", "[[Ár 1990]][[Já!?]]", "Hús- og bóka-\n og 1939-1945", "x 12 %... 13"):
        want = [t for t in engine.tokenize(text) if t.kind == kind and t.txt]
        assert engine.Engine().of_kinds(text, frozenset([kind])) == want


def test_short_texts_that_come_again_are_tokenized_once_a_task(spark):
    """ordinals"""
    texts = spark.range(400).selectExpr("id", "concat('Þetta er ', id % 2, '. grein laganna.') as text")
    found = frames.per_text(texts, "text", ["id"], [("at", "string", pa.string())], lambda value: [(uuid.uuid4().hex,)])
    assert found.count() == 400
    assert found.select("at").distinct().count() <= 2 * found.rdd.getNumPartitions() < 400


def test_kinds_are_counted_where_the_texts_are(spark):
    """kind_histogram"""
    texts = [(1, "Hann fór 5. maí 1990 kl. 9:05. Hún kom!\n\n[[Já.]]"), (2, None), (3, ""), (4, "5 %, 6 %")]
    found = frames.kind_counts(spark.createDataFrame(texts, "doc_id int, text string")).collect()
    want = [(k, *x) for k, text in texts if text for x in Counter(kind_name(t.kind) for t in engine.tokenize(text) if t.txt).items()]
    assert sorted(map(tuple, found)) == sorted(want)


@pytest.mark.parametrize("name", ["temperatures", "percent_words", "measurements", "numbers_converted", "percentages"])
def test_only_the_wanted_tokens_leave_python(spark, tiny, name):
    above = plan(name, spark, tiny).split("MapInArrow")[0]
    assert "Filter" not in above and "kind" not in above


def test_the_rollup_expands_counts_and_not_tokens(spark, tiny):
    """kind_rollup"""
    assert "HashAggregate" in plan("kind_rollup", spark, tiny).split("Expand")[-1]


def test_table_functions_get_small_inputs_spread(spark, tiny):
    """sql_options"""
    assert "RoundRobinPartitioning" in plan("sql_options", spark, tiny)


def test_arrays_of_tokens_are_made_field_by_field():
    """originals_restored"""
    lists = [engine.tokenize("Hann  fór."), [], engine.tokenize("5 m")]
    found = frames._struct_lists(["original", "kind"])(lists)
    assert found.to_pylist() == [[{"original": t.original, "kind": int(t.kind)} for t in one] for one in lists]


def test_tokens_of_a_text_are_not_gathered_by_a_shuffle(spark, tiny):
    """lexer_rules"""
    assert "hashpartitioning" not in plan("lexer_rules", spark, tiny)


def test_inert_words_are_made_once_and_callers_get_their_own():
    """document_sentences"""
    own = engine.Engine()
    words = [[t for t in own.tokenize(text) if type(t) is Inert] for text in ("Hann fór heim.", "Hún fór út.")]
    assert words[0][1] is words[1][1] and words[0][1].txt == "fór"
    mine = engine.tokenize("Hann fór heim.")
    mine[2].txt = "kom"
    assert [t.txt for t in engine.tokenize("Hann fór heim.")] == ["", "Hann", "fór", "heim", ".", ""]


def test_words_of_one_language_only_without_a_join(spark, tmp_path):
    """french_only_words: no task gets all occurrences of a word."""
    rows = [("fr", "le chat le chat"), ("en", "the chat"), ("de", "le"), ("fr", None), (None, "le"), ("fr", "une")]
    spark.createDataFrame(rows, "lang string, text string").selectExpr("monotonically_increasing_id() as doc_id", "*").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r[0] for r in QUERIES["french_only_words"](spark, str(tmp_path)).collect()) == ["le", "une"]
    assert "Join" not in plan("french_only_words", spark, str(tmp_path))


def test_paragraphs_give_the_columns_asked_for(spark):
    """document_paragraphs"""
    docs = spark.createDataFrame([(1, "[[Já. Nei.]][[Hér.]]")], "doc_id int, text string")
    found = frames.paragraphs(docs, fields=["sent_no", "para_idx"])
    assert found.columns == ["doc_id", "sent_no", "para_idx"]
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0), (1, 0, 1), (1, 1, 0)]


@pytest.mark.parametrize("options", [{}, {"compose": False}])
def test_words_before_a_mark_are_lexed_without_the_steps(monkeypatch, options):
    """documents_respaced"""
    words = ["Hús", "nr", "kg", "maí", "USD", "IV", "C", "og", "þ", "ﬁx", "ªa", "日本"]
    want = {word + c: [*lexer.Lexer(**options)._lex(word + c)] for word in words for c in lexer._CLOSING}
    own = lexer.Lexer(**options)
    monkeypatch.setattr(own, "_lex", None)
    for text, pieces in want.items():
        found = own.ready[" " + text]
        assert [(t.kind, len(t.txt), t.val, type(t) is Inert) for t in found] == [(p.kind, p.size, p.val, p.inert) for p in pieces]
        assert "".join(t.original for t in found) == " " + text


def test_plain_texts_are_not_split_at_breaks(monkeypatch):
    """sentence_numbers"""
    text = "Pöntun 5 var send. Hún kostaði 1.234,50 kr. Henni var skilað!"
    monkeypatch.setattr(segment, "_HARD_BREAK", None)
    assert engine.Engine().sentences(text) == ["Pöntun 5 var send .", "Hún kostaði 1.234,50 kr.", "Henni var skilað !"]

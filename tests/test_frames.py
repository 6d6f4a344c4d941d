"""DataFrames of tokens, files, streams and the SQL surface."""

import hashlib
import json
import os
import shutil
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tokenfjord import mark_paragraphs, session, sql
from tokenfjord.operators import abbreviations, engine, frames, spacing, tokens
from tokenfjord.plans import queries as plans
from tokenfjord.plans import rules
from tokenfjord.sources import files
from tokenfjord.streaming import texts as streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Jón kom 3. maí 2010. Hann átti 12,5 kg.", "x"), (2, None, "x"), (3, "", "x"), (4, "[[Ein.]][[Tvær.]]", "x"), (None, "a" * 10_000, "x")], "doc_id long, text string, kind string")


def test_token_rows(docs):
    rows = {(r["doc_id"], r["sent_idx"], r["tok_idx"]): r for r in frames.tokens(docs).collect()}
    date = rows[1, 0, 2]
    assert (date["kind"], date["y"], date["mo"], date["d"], date["original"]) == (18, 2010, 5, 3, " 3. maí 2010")
    assert (rows[1, 1, 2]["num"], rows[1, 1, 2]["unit"]) == (12.5, "kg")
    assert {k[0] for k in rows} == {1, 4, None} and rows[4, 1, 0]["para_idx"] == 1
    assert rows[1, 0, 3]["norm"] == "." and rows[1, 0, 3]["tp"] == 3


def test_arrays_sentences_and_paragraphs(docs):
    assert [r["n"] for r in frames.token_arrays(docs).orderBy("doc_id").select(F.size("tokens").alias("n")).collect()][-1] == 12
    assert frames.sentences(docs).where("doc_id = 1").count() == 2
    assert [r["para_idx"] for r in frames.paragraphs(docs).where("doc_id = 4").orderBy("para_idx").collect()] == [0, 1]
    assert frames.raw_tokens(docs).where("doc_id = 4").count() == 6
    assert frames.lexed(docs).where("doc_id = 1 and kind = 5").count() == 2
    assert frames.respaced(docs).where("doc_id = 1").first()["respaced"] == "Jón kom 3. maí 2010. Hann átti 12,5 kg."


def test_offsets_of_tokens(spark):
    frame = spark.createDataFrame([(1, "Á bát í dag")], "doc_id long, text string")
    rows = frames.offsets(frames.lexed(frame)).orderBy("tok_idx").collect()
    assert [r["char_start"] for r in rows] == [0, 1, 5, 7] and [r["byte_start"] for r in rows] == [0, 2, 7, 10]


def test_chunks_in_any_order(spark):
    parts = spark.createDataFrame([(1, 2, "kom. Svo"), (1, 1, "Hann "), (1, 3, ""), (1, 4, "fór")], "doc_id long, chunk_no int, chunk string")
    whole = frames.chunked(parts)
    assert [r["sentence"] for r in frames.sentences(whole).orderBy("sent_idx").collect()] == engine.split_into_sentences(["Hann ", "kom. Svo", "", "fór"])


def test_lexing_the_vocabulary_is_lexing_the_corpus(spark, tiny):
    documents = spark.read.parquet(f"{tiny}/documents.parquet")
    whole = frames.lexed(documents, fields=("kind", "txt")).where("kind < 10000").groupBy("kind", "txt").agg(F.count("*").alias("n"))
    once = frames.lexed_vocabulary(documents).groupBy("kind", "txt").agg(F.sum("n").alias("n"))
    assert whole.exceptAll(once).count() == 0 and once.exceptAll(whole).count() == 0 and once.count() > 1000


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hann kom.\n\nHún fór.", encoding="utf-8")
    read = files.read_documents(spark, str(tmp_path / "a.txt"))
    files.write_lines(read, str(tmp_path / "out"), "json", keys=("path",))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [x["k"] for x in lines].count("BEGIN SENT") == 2
    files.write_tokens(read, str(tmp_path / "tokens"), keys=("path",))
    assert spark.read.parquet(str(tmp_path / "tokens")).count() == 6
    assert files.read_lines(spark, str(tmp_path / "a.txt")).count() == 3


def test_dictionary_as_a_table(spark, tmp_path):
    forms = abbreviations.table(spark)
    assert {r["meaning"] for r in forms.where("form = 'td'").collect()} == {"til dæmis"}
    (tmp_path / "d.conf").write_text('[abbreviations]\nq. = "spurning" kvk\n', encoding="utf-8")
    assert abbreviations.read(spark, str(tmp_path / "d.conf")).meanings("q.")[0][0] == "spurning"


def test_sql_functions(spark, docs):
    sql.register(spark)
    docs.createOrReplaceTempView("some_docs")
    rows = spark.sql("SELECT t.txt FROM some_docs d, LATERAL tokenize(d.text) t WHERE t.kind_name = 'MEASUREMENT'").collect()
    assert [r["txt"] for r in rows] == ["12,5 kg"]
    assert spark.sql("SELECT correct_spaces('a , b'), tidy('Sagði \"hæ\" !'), tidy(NULL)").first() == ("a, b", "Sagði „hæ“!", None)


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    frame = spark.createDataFrame([(1, 1, "Ein setning. Og"), (1, 2, " önnur.\n\nHálf"), (2, 1, "Bara þessi"), (2, 2, "")], "doc_id long, chunk_no int, chunk string")
    frame.write.parquet(str(source))
    stream = spark.readStream.schema(frame.schema).parquet(str(source))
    run = streams.chunk_sentences(stream, idle="1 second").writeStream.format("memory").queryName("chunk_out").outputMode("append").trigger(processingTime="1 second").start()
    end = time.time() + 45
    while time.time() < end and spark.table("chunk_out").count() < 4:
        time.sleep(0.5)
    run.stop()
    rows = sorted((r["doc_id"], r["sent_idx"], r["sentence"]) for r in spark.table("chunk_out").collect())
    assert [r for r in rows if r[0] == 1][:2] == [(1, 0, "Ein setning ."), (1, 1, "Og önnur .")]
    assert (2, 0, "Bara þessi") in rows and (1, 2, "Hálf") in rows
    whole = streams.tokens(spark.readStream.schema("doc_id long, text string").json(str(tmp_path / "none*")), fields=("kind",))
    assert whole.isStreaming


def test_event_counts_have_a_watermark(spark, tmp_path):
    frame = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 01:00:00", "b")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "events"))
    run = streams.counts(stream).writeStream.format("memory").queryName("event_out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r["event_type"], r["n"]) for r in spark.table("event_out").collect()] == [("a", 2)]


QUERIES, ORACLES = plans.QUERIES | rules.QUERIES, plans.ORACLES | rules.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, tiny, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, tiny)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    plain = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert plain(got.select(columns).collect()) == plain(want.select(*columns).fetchall())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {r["lang"] for r in rows} == {"en", "de", "fr", "es"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_small_inputs_are_spread_and_streams_are_not(spark, tiny, tmp_path):
    assert "RoundRobinPartitioning" in frames.spread(spark.read.parquet(f"{tiny}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    stream = spark.readStream.schema("doc_id long, text string").json(str(tmp_path))
    assert frames.spread(stream) is stream


def test_coverage_names_what_exists():
    import re
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    tests = "".join(p.read_text(encoding="utf-8") for p in (here / "tests").glob("*.py"))
    for name in re.findall(r"`([a-z_]+)`", "".join(line.rsplit("|", 2)[1] for line in (here / "COVERAGE.md").read_text(encoding="utf-8").splitlines()[3:] if line.startswith("|"))):
        assert name in QUERIES or f"def {name}(" in tests, name


def test_whole_documents_equal_a_loop_over_the_engine(spark, tiny):
    """The queries that have no SQL, text by text in plain Python."""
    texts = [(r["doc_id"], r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    kinds, by_lang, sources, sentences, respaced, grouped, lexed = Counter(), Counter(), {}, [], [], [], Counter()
    for doc_id, lang, source, text in texts:
        found = engine.tokenize(text)
        for t in found:
            if t.txt:
                name = tokens.kind_name(t.kind)
                kinds[lang, name] += 1
                for key in ((lang, name), (lang, None), (None, None)):
                    by_lang[key] += 1
                    sources.setdefault(key, set()).add(source)
        split = engine.split_into_sentences(text)
        if split:
            sentences.append((doc_id, len(split), max(map(len, split))))
        respaced.append((doc_id, hashlib.md5(spacing.detokenize(found).encode()).hexdigest()))
        paragraphs = engine.paragraphs(engine.tokenize(mark_paragraphs(text)))
        if paragraphs:
            grouped.append((doc_id, len(paragraphs), sum(map(len, paragraphs))))
        lexed.update(tokens.kind_name(t.kind) for t in engine.parse_tokens(text) if t.kind < 10000)

    def rows(name):
        return sorted(map(tuple, QUERIES[name](spark, tiny).collect()), key=str)

    assert rows("kind_histogram") == sorted(((*k, n) for k, n in kinds.items()), key=str)
    assert rows("kind_rollup") == sorted(((*k, n, len(sources[k])) for k, n in by_lang.items()), key=str)
    assert rows("document_sentences") == sorted(sentences, key=str)
    assert rows("documents_respaced") == sorted(respaced, key=str)
    assert rows("document_paragraphs") == sorted(grouped, key=str)
    assert {k: n for k, n in rows("lexed_kinds") if k in lexed} == lexed


def test_sql_options(spark):
    sql.register(spark)
    found = spark.sql("SELECT t.kind_name, t.txt FROM VALUES ('3,500.5 USD') d(x), LATERAL tokenize(d.x, 'convert_numbers, no_with_annotation') t").collect()
    assert [tuple(r) for r in found] == [("NUMBER", "3.500,5"), ("WORD", "USD")]
    with pytest.raises(Exception, match="no such options"):
        spark.sql("SELECT t.* FROM VALUES ('x') d(x), LATERAL sentences(d.x, 'no_such') t").collect()


def test_a_local_folder_is_for_one_process_only():
    class Fake:
        def __init__(self, master):
            self.sparkContext = self.conf = self
            self.master = master

        def get(self, name, default=None):
            return default

        def getConf(self):  # noqa: N802
            return self

    assert session.shared_dir(Fake("local")) == session.shared_dir(Fake("local[*]")) == session.LOCAL_CHECKPOINTS
    for master in ("local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Fake(master))


def test_only_absent_folders_are_passed_over(tmp_path):
    """The entry imports without the training-data folder, and fails if that folder is broken."""
    here = Path(__file__).resolve().parents[1]
    shutil.copytree(here / "tokenfjord", tmp_path / "tokenfjord", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    run = [sys.executable, "-c", "import __spark_entry__ as e; print(any(n.startswith('op') for n in e.queries()))"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run(run, cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.strip() == "False"
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_missing\n")
    assert subprocess.run(run, cwd=tmp_path, env=env, capture_output=True, check=False).returncode != 0

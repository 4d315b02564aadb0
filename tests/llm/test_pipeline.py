"""The pipeline as a whole, against the plain versions of its stages, and the entry point without it."""

import os
import subprocess
import sys

import brute
import corpus_pipeline
from featureflow.llm import simhash
from test_tokens_pages_vectors import _held

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_run(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{brute.FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows if brute.verdict(brute.measures(t))[1]]
    rows = sorted(brute.dedup_lines(rows).items())
    groups = brute.near(rows, 3)
    rows = [(i, brute.redact(t)) for i, t in rows if groups[i][1] == i]
    got = corpus_pipeline.run(spark, brute.FOLDER).collect()
    missing, sequences = _held(got, rows, 4096)
    assert missing < 0.02 * 4096 * sequences + 4096


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{brute.FOLDER}/documents.parquet").limit(40)
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, brute.FOLDER)
        assert out.columns == docs.columns
        assert all(r.n_chars == len(r.text) for r in out.collect())
        assert stage(spark, docs.limit(0), brute.FOLDER).count() == 0


def test_stages_on_odd_rows(spark):
    text = "the plain words of this short text are told here once for all to read and to keep as they stand in the book of the day"
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text + " and more"), (None, None), (4, " \t\n"), (5, text.replace("plain", "simple"))]
    schema = "doc_id long, text string, line long, key string, version string, f long, at int"
    docs = spark.createDataFrame([(*r, 1, "k", "v", 2, 3) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, brute.FOLDER)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), brute.FOLDER).count() == 0
        texts = [r.text for r in out.collect()]
        assert len(texts) == {"quality rules": 4, "line dedup": 8, "near dedup": 5, "secret scan": 8}[name], name
        assert texts.count(None) == (0 if name == "quality rules" else 2), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, brute.FOLDER)
    assert packed.count() >= 8 and packed.groupBy("sequence_id", "offset").count().where("count > 1").isEmpty()


def test_near_dedup_sends_no_exploded_halves(spark, monkeypatch):
    plans = []

    def seen(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return spark.createDataFrame(rows, df.schema)

    monkeypatch.setattr(simhash, "checkpointed", seen)
    docs = spark.read.parquet(f"{brute.FOLDER}/documents.parquet")
    assert 0 < corpus_pipeline.near_dedup(spark, docs, brute.FOLDER).count() <= docs.count()
    asked = [p for p in plans if "Generate explode(concat(" in p and "SortMergeJoin" in p]
    assert asked and not any("BroadcastHashJoin" in p for p in asked)


def test_entry_without_the_subpackage(tmp_path):
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; "
        "assert 'derive_all' in e.queries() and not [q for q in e.queries() if q.startswith('op')] and 'pipeline' not in e.queries()"
    )
    assert subprocess.run([sys.executable, "-c", code, ROOT], cwd=tmp_path).returncode == 0

"""Every query with an SQL counterpart gives the same rows on another engine."""

import os
import subprocess
import sys

import pytest
from checks import difference, duck

from featureflow.plans.catalog import QUERIES
from featureflow.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_bernoulli_sample_is_a_plausible_subset(spark):
    rows = [r.o_orderkey for r in QUERIES["bernoulli_sample"](spark, FOLDER).collect()]
    total = spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    assert len(rows) == len(set(rows))
    assert 0.65 * total < len(rows) < 0.85 * total


def test_score_unlabelled_covers_every_unlabelled_document(spark, con):
    got = QUERIES["score_unlabelled"](spark, FOLDER).collect()
    want = con.execute("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)").fetchall()
    assert sorted(r.id for r in got) == sorted(w[0] for w in want)
    assert all(r.valid for r in got)


@pytest.mark.parametrize("package", ["public_tokenizers", "xxhash", "regex", "featureflow.llm", "corpus_pipeline"])
def test_entry_without_a_package_of_the_optional_part(package):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.modules[{package!r}] = None; sys.path.insert(0, {root!r}); import __spark_entry__ as e; assert 'lr_cv' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0

"""Every registered query against its SQL, on whole tables."""

import os
import subprocess
import sys

import compare
import pytest

import __spark_entry__ as contract
from guardframe.plans.oracle import ORACLE_SQL
from guardframe.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert compare.compare(spark, con, sf_dir, contract.queries()[name], contract.oracle_sql()[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "text", "redaction_applied"]
    assert df.where("redaction_applied").count() > 0


@pytest.mark.parametrize("hidden", ["tiktoken", "xxhash", "corpus_pipeline", "guardframe.llm"])
def test_plain_queries_stand_without_the_others_packages(hidden):
    root = os.path.dirname(contract.__file__)
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))] and "without" in done.stderr

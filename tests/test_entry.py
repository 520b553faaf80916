"""The driver's contract, with and without the corpus operators."""

import subprocess
import sys

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score"] and df.count() > 0


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "ranked_or_top10" in sql


def test_nothing_needs_the_corpus_operators():
    code = "import re, sys; sys.modules['quern.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(re.match(r'op[0-9]', k) or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])

"""Queries against their SQL in DuckDB, on small tables."""

import math
import os
import pathlib
import shutil
import subprocess
import sys
from functools import reduce

import duckdb
import pytest
from pyspark.sql import DataFrame

import __spark_entry__
from quillgraph.operators import questions
from quillgraph.plans import catalogue
from quillgraph.sources import tables
from quillgraph.sources.shared import materialized

#: Question types share one generator here; what is made of all of them is compared once.
TYPES = catalogue.ALL_TYPES
FAST = [q for q in catalogue.oracle_sql() if q not in ("candidate_scores", "summary_grouping_sets", "validation_verdicts", *TYPES)]


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    a = sorted(tuple(cell(r[c]) for c in sorted(got.columns)) for r in got.collect())
    assert a == sorted(tuple(cell(r[i]) for i in order) for r in want.fetchall()) and a


@pytest.mark.parametrize("name", FAST)
def test_query(spark, sf, duck, name):
    same(catalogue.queries()[name](spark, sf), duck.sql(catalogue.oracle_sql()[name]))


def test_question_types(spark, sf, duck):
    """All ten types, their counts and the verdicts on them, sound and spoiled."""
    made = questions.Generator(tables.order_graphs(spark, sf))
    parts = []
    for name, method in TYPES.items():
        parts.append(materialized(getattr(made, method)()))
        same(catalogue._flat(parts[-1]), duck.sql(catalogue.oracle_sql()[name]))
    every = reduce(DataFrame.unionByName, parts)
    same(questions.summarize(every), duck.sql(catalogue.oracle_sql()["summary_grouping_sets"]))
    same(catalogue._judged(every, made.context), duck.sql(catalogue.oracle_sql()["validation_verdicts"]))
    lines = questions.summary_lines(questions.summarize(every)).collect()
    assert lines[0]["group"] == "all" and lines[0]["n"] == every.count() and [r["group"] for r in lines] == sorted(r["group"] for r in lines)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5 and set(catalogue.oracle_sql()) <= set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_rest_works_without_what_can_be_taken_out(tmp_path):
    """A copy without the training-data operators, their tests and the pipeline still has all other queries."""
    root = pathlib.Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "quillgraph", tmp_path / "quillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = set(e.queries()); assert q == set(e.oracle_sql()) and not any(x.startswith('op') or x == 'pipeline' for x in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert int(out.stdout) == len(catalogue.queries()), out.stderr
    broken = tmp_path / "quillgraph" / "llm"
    broken.mkdir()
    (broken / "__init__.py").write_text("")
    (broken / "queries.py").write_text("import no_such_module_at_all")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert "no_such_module_at_all" in out.stderr and out.returncode

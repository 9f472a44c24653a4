"""Every registered query against its SQL, and properties every plan must have."""

import subprocess
import sys
from pathlib import Path

import pytest
from compare import duck, duck_rows, spark_rows

from shelfmark.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    frame = QUERIES[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan
    rows = spark_rows(frame)
    if name in ORACLES:
        assert rows == duck_rows(con, ORACLES[name])
        types = {d[0]: str(d[1]) for d in con.execute(ORACLES[name]).description}
        assert {c: DUCK_TYPES[t] for c, t in frame.dtypes} == types


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("absent", ["tiktoken", "corpus_pipeline", "shelfmark.llm"])
def test_catalog_queries_without_the_optional_part(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert found.stdout.split() == [str(len(QUERIES)), "False"]


def test_identity_of_the_catalog(spark):
    """Listed, uncategorised and hidden items together are all items."""
    from shelfmark.operators import listing as R
    from shelfmark.plans.star import Star

    star = Star(spark, "/root/testdata/sf0.01")
    items, categories = star.items(), star.categories()
    listed = R.in_active_category(items, categories)
    orphans = R.orphan_items(items, categories)
    hidden = R.unassigned_excluded(items, categories.where("not is_active"))
    assert (listed.count(), orphans.count(), hidden.count()) == (1141, 73, 286)
    assert listed.select("category_id").distinct().count() == 19
    assert [r.id for r in R.empty_categories(categories, items).collect()] == [7]
    assert items.where("not is_available").count() == 122


def test_scans_push_filters_and_prune_columns(spark):
    plan = QUERIES["filter_eq"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "c_acctbal" not in plan.split("ReadSchema")[1]

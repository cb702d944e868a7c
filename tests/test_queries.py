"""Every registered query against its SQL, row for row."""

import math
from collections import Counter
from datetime import datetime

import pytest

from memlattice.plans import catalog_analytics, catalog_more, catalog_predicates, catalog_records, catalog_retrieval, catalog_structures  # noqa: F401
from memlattice.plans.registry import ORACLE, QUERIES


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def compare(frame, duck, sql):
    names = sorted(frame.columns)
    ours = Counter(tuple(cell(row[n]) for n in names) for row in frame.collect())
    relation = duck.execute(sql)
    found = [d[0] for d in relation.description]
    assert sorted(found) == names
    theirs = Counter(tuple(cell(row[found.index(n)]) for n in names) for row in relation.fetchall())
    assert ours == theirs, f"{list((ours - theirs).items())[:3]} / {list((theirs - ours).items())[:3]}"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    compare(QUERIES[name](spark, sf_dir), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    assert frame.columns and frame.collect() is not None

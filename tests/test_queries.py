"""Every registered query of the library against its SQL, and a stable schema for those without."""

import pandas as pd
import pytest

import __spark_entry__ as entry

NAMES = sorted(n for plan in entry.PLANS for n in plan.queries)


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return str(t.tz_localize(None) if t.tzinfo else t)
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


#: Queries whose result is empty on the smallest tables, and not on larger ones.
EMPTY = {"irreproducible_set", "notifications"}


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, duck):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert cols and (got or name in EMPTY)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_library_does_not_import_the_training_data_operators():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for f in (root / "tessella").rglob("*.py"):
        if "llm" not in f.relative_to(root / "tessella").parts:
            assert "tessella.llm" not in f.read_text(), f

"""The entry points, with or without the corpus operators."""

import __spark_entry__ as entry


def test_names_agree():
    names, sql = entry.queries(), entry.oracle_sql()
    assert len(names) >= 45 and set(sql) <= set(names)
    assert ("pipeline" in names) == entry.HAS_PIPELINE

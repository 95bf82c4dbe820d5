import __spark_entry__ as entry

from reelgrain.plans import catalogue


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"clip", "verdict"} <= set(rows[0].asDict())


def test_catalogue_is_consistent():
    q, sql = catalogue.queries(), catalogue.oracle_sql()
    assert len(q) > 70 and set(sql) <= set(q)
    assert set(q) <= set(entry.queries())


def test_core_does_not_need_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "reelgrain"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "reelgrain.llm" not in p.read_text()

import pytest
from compare import differences, duck
from conftest import DATA

from palimpsest import catalog


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert differences(catalog.QUERIES[name](spark, DATA), con, catalog.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_few_queries_without_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"partitions"}


def test_partitions(spark):
    import zlib
    from urllib.parse import quote

    for r in catalog.QUERIES["partitions"](spark, DATA).collect():
        first = r.key.split("/")[0]
        plain = quote(first, safe="~/")
        assert r.partition == f"{zlib.adler32(first.encode()) & 0xFF:02x}/{plain}"
        safe = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789 _.,()@;-" else "".join(f"%{b:02x}" for b in c.encode()) for c in first)
        assert r.escaped == f"{zlib.adler32(safe.encode()) & 0xFF:02x}/{quote(safe, safe='~/')}"
        assert r.hash_255 == "00".join("".join("5F" if f"{b:02X}" == "0A" else f"{b:02X}" for b in zlib.crc32(x.encode()).to_bytes(4, "big")) for x in r.key.split("/"))


def test_no_query_passes_on_nothing(spark, con):
    empty = [n for n, sql in catalog.ORACLE.items() if con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] == 0]
    assert empty == [], empty


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["snapshot", "file_id", "change"]

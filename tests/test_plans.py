"""The queries' inputs are whole tables."""

import duckdb

from swardbook.operators import linkage
from swardbook.plans import linking

DATA = "/root/testdata/sf0.01"


def test_linkage_meets_the_whole_roster(spark, monkeypatch):
    seen = {}

    def spy(name):
        def run(names, roster, *_):
            seen[name] = (names.count(), roster.count())
            return names

        return run

    n = duckdb.sql(f"SELECT count(*) FROM '{DATA}/customer.parquet'").fetchall()[0][0]
    m = duckdb.sql(f"SELECT count(*) FROM '{DATA}/supplier.parquet'").fetchall()[0][0]
    for query, operator in (("filing_clients", "file_clients"), ("suggest_clients", "suggest_clients"), ("open_conflicts", "open_conflicts")):
        monkeypatch.setattr(linkage, operator, spy(query))
        linking.QUERIES[query](spark, DATA)
    assert seen == {"filing_clients": (n, n), "suggest_clients": (n, n), "open_conflicts": (n + m, n)}


def test_oracles_are_sql():
    import __spark_entry__

    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())


def test_part_numbers_of_seven_digits_stay_in_work_cells(spark, tmp_path):
    from swardbook.operators import sheets
    from swardbook.plans import upkeep

    spark.createDataFrame([(7,), (999_999,), (1_000_000,), (12_345_678,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    rows = {tuple(r) for r in upkeep.QUERIES["work_row_cells"](spark, str(tmp_path)).collect()}
    part = duckdb.read_parquet(f"{tmp_path}/part.parquet/*.parquet")  # noqa: F841
    assert rows == set(duckdb.sql(upkeep.ORACLES["work_row_cells"]).fetchall())
    # A bare number of that length is a phone all the same.
    cells = spark.sql("SELECT array('A', '1000000', '9') AS c")
    assert cells.select(sheets.work_cells(cells["c"], 3)).first()[0] == ["A", "", "9"]

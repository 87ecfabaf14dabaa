import os

import duckdb
import pytest

from bytefold.llm import entry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"scope": "string", "scope_id": "bigint", "license": "string"},
    "p2_found": {"file_id": "bigint", "secret": "string"},
    "p3_found": {"field": "string", "item": "string"},
    "p4_found": {"file_id_a": "bigint", "file_id_b": "bigint"},
    "p5_found": {"file_id": "bigint"},
    "p6_found": {"file_id": "bigint", "line_no": "bigint", "lang": "string"},
    "p7_found": {"scope": "string", "id_a": "bigint", "id_b": "bigint"},
    "p8_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p10_found": {"doc_id": "bigint"},
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    df = entry.QUERIES[name](spark, SF)
    assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == len({tuple(map(str, r)) for r in rows}) or name == "p6_found"
    if name == "p1_found":
        assert len(rows) == spark.read.parquet(f"{SF}/code_repo.parquet").count() + spark.read.parquet(f"{SF}/corpus_file.parquet").where("suffix in ('.py', '.js', '.mjs', '.cjs', '.ts', '.java', '.cpp')").count()
    if name == "p8_ids":
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", list(entry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    df = entry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)

"""Queries on texts whose words begin like a route and go on with letters beyond ASCII."""

import duckdb
import pytest

from spanloom.plans import catalogue


@pytest.mark.parametrize("name", ["extract_drugs", "extract_lines"])
def test_drugs_before_letters_beyond_ascii_equal_their_sql(spark, tmp_path, name):
    words = [f"w{chr(97 + i)}ordab" for i in range(16)]
    lines = [f"{w} imßtz {w}, imäu {w} im. {w} PRÉ {w} 5 gé {w} po {w} x 12é" for w in words]
    spark.createDataFrame([(i, t + " of le") for i, t in enumerate(lines)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.execute(catalogue.ORACLE_SQL[name]).fetchall()
    got = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert want and sorted(tuple(r) for r in got) == sorted(want)

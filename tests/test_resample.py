import pytest

from millrace.plans import catalog


def test_resample_draws_as_many_rows_as_there_are_by_squared_score(spark, tmp_path):
    """Orders 0 to 2999 score 1, order 5000 scores 60: a weight of 3600 among 6600."""
    lines = [(k, 1, 1, 1, "1998-01-01", 60.0 if k == 5000 else 1.0) for k in [*range(3000), 5000]]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_quantity double"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["pf_reweight_resample"](spark, str(tmp_path)).collect()
    assert len(got) == 3001 and {r.draw for r in got} == set(range(3001))
    assert sum(r.row_id == 5000 for r in got) / 3001 == pytest.approx(3600 / 6600, abs=0.04)
    assert any(2000 <= r.row_id < 3000 for r in got)

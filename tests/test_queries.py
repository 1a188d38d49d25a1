import pytest

from pyspark.sql import functions as F

from corvidex.queries import ORACLES, QUERIES, keyword_table
from tests.compare import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


def test_stored_index_with_faults_differs_on_both_sides(spark):
    rows = QUERIES["index_consistency"](spark, SF).collect()
    assert any(r.stored == 0 for r in rows) and any(r.fresh == 0 for r in rows) and any(0 < r.stored < r.fresh for r in rows) and any(r.stored == r.fresh for r in rows)


def test_stored_tables_are_built_once_and_read_pruned(spark, tmp_path):
    """A second query reads the table as it is; a lookup pushes its keyword down; another source, another table."""
    kw = keyword_table(spark, SF)
    again = keyword_table(spark, SF)
    assert kw.inputFiles() == again.inputFiles() and kw.count() == again.count() > 0
    hits = again.where(F.col("keyword") == "the-word")
    assert "EqualTo(keyword,the-word)" in hits._jdf.queryExecution().toString()
    (tmp_path / "documents.parquet").mkdir()
    spark.createDataFrame([(1, "ant bee"), (2, "ant bee cow"), (3, "bee ant"), (4, "dog")], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    other = keyword_table(spark, str(tmp_path))
    assert other.inputFiles() != kw.inputFiles()


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0

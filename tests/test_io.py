"""The fit store: written once, read afterwards, never overwritten because of a read error."""
import pytest
from pyspark.errors import AnalysisException

from trialscope.sources import io


def test_fit_is_written_once_and_reused(spark, tmp_path):
    path = str(tmp_path / "fit")
    first, other = spark.range(3), spark.range(7)
    assert io.persist_fit(first, path).count() == 3
    assert io.persist_fit(other, path).count() == 3
    assert io.persist_fit(other, path, reuse=False).count() == 7


def test_unreadable_fit_stays(spark, tmp_path):
    broken = tmp_path / "fit"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        io.persist_fit(spark.range(3), str(broken)).count()
    assert (broken / "part-0.parquet").read_text() == "not parquet"
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(AnalysisException):
        io.persist_fit(spark.range(3), str(empty))

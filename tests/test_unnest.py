"""E10 unnests lists of a bounded length, not one list a worker, and its rows match the oracle's."""
import __spark_entry__ as entry
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.oracle_check import compare, duck
from trialscope.operators import aggregates as D
from trialscope.operators import reshape as E


def test_unnest_reads_bounded_lists(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 4, raising=False)
    longest, plain = [], E.unnest

    def seen(df, cols, pos=None):
        longest.extend(df.agg(*[F.max(F.size(c)) for c in cols]).first())
        return plain(df, cols, pos)

    monkeypatch.setattr(E, "unnest", seen)
    out = entry.queries()["E10_unnest"](spark, SMALL)
    most = out.agg(F.max("pos")).first()[0]
    assert most > 8 and longest == [4, 4]


def test_collect_chunks_keeps_every_row(spark):
    rows = [(w, i, None if i % 5 == 0 else i * 0.5) for w, n in ((1, 23), (2, 4), (None, 9)) for i in range(n)]
    lists = D.collect_chunks(spark.createDataFrame(rows, "w int, i int, v double"), ["w"], ["i"], ["i", "v"], 4)
    out = E.unnest(lists, ["i", "v"], pos="pos").collect()
    assert sorted(((r.w, r.i, r.v) for r in out), key=str) == sorted(rows, key=str)
    assert all(r.offset + r.pos == r.i + 1 for r in out)

"""Scopes of written tables, and orders that survive a re-read."""

import os

import pytest

from corvane import storage


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_scopes(spark):
    with storage.workspace(spark) as outer:
        with storage.workspace(spark) as inner:
            gone = folder(storage.written(spark.range(5), "gone"))
            kept = inner.keep(storage.written(spark.range(6), "kept", narrow=True))
            bucketed = inner.keep(storage.dealt(spark.range(100), "dealt", "id"))
        assert not os.path.exists(gone) and os.path.exists(folder(kept))
        assert kept.count() == 6 and bucketed.count() == 100
        where, table = folder(bucketed), storage._tables[next(p for p in storage._tables if p.removeprefix("file://") in folder(bucketed))]
        outer.keep(kept)
    assert os.path.exists(folder(kept)) and not os.path.exists(where) and not spark.catalog.tableExists(table)
    with storage.workspace(spark) as held:
        df = held.keep(storage.written(spark.range(3), "mine"))
        left = held.release()
    assert len(left) == 1 and df.count() == 3
    storage.remove(spark, left[0])
    with pytest.raises(ZeroDivisionError), storage.workspace(spark):
        lost = folder(storage.written(spark.range(5), "lost"))
        raise ZeroDivisionError
    assert not os.path.exists(lost)


def test_joins_on_dealt_tables_do_not_shuffle_them(spark):
    big = storage.dealt(spark.range(1000).selectExpr("id as a", "id % 7 as b", "id as payload"), "big", "a", "b")
    other = spark.range(300).selectExpr("id as a", "id % 7 as b", "id as more")
    plan = big.join(other.hint("merge"), ["a", "b"], "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_broadcasts_only_what_is_counted_small(spark):
    small = storage.written(spark.range(10), "small")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(storage.few(small)) and not hinted(storage.few(small, storage.BROADCAST_BYTES))

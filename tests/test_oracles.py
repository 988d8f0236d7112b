"""Every registered query of the retrieval catalog against its SQL twin on the smallest data."""

import glob
import os

import duckdb
import pytest

from corvane import storage
from corvane.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


#: Queries of several written tables; in the shared folder only those stay that the result reads.
LEAN = {"bm25_padded", "hybrid_metrics", "robustness", "business_breakdown", "golden_leaderboard", "golden_leaderboards", "leaderboard", "paired_bootstrap", "event_intervals"}


def tables(spark):
    home = storage.shared_dir(spark).removeprefix("file:") + "/corvane"
    return {f"{home}/{d}" for d in os.listdir(home)} if os.path.isdir(home) else set()


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sql, name):
    before = tables(spark)
    df = QUERIES[name](spark, DATA)
    assert name not in LEAN or tables(spark) - before <= {os.path.dirname(f.removeprefix("file://")) for f in df.inputFiles()}
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert df.columns and rows is not None
        return
    found = sql.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(found.fetchall(), columns)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_doc_prefix_of_long_and_unnamed_documents(spark, tmp_path):
    """Texts beyond the band amid a group; groups whose language, source or ids are null; names that two groups share."""
    groups = {("en", "a"): [3000, 9000, *[100] * 60], ("en", "b"): [7500, None, 9000, *[10] * 60], ("en", "c"): [None, 7500, None, 300, 300], ("en", "d"): [7999, 0, 1, 0],
              (None, "a"): [7100, 1], (None, "b"): [500, 20], ("en", None): [7300, 3, 900], (None, None): [40], ("a/b", "c"): [7100], ("a", "b/c"): [7200, 3]}
    rows = [(lang, source, None if n is None else "word " * n) for (lang, source), counts in groups.items() for n in counts]
    rows = [(i, *r) for i, r in enumerate(rows)] + [(None, "en", "e", "word " * 900), (1000, "en", "e", "word " * 7000), (1001, "en", "e", "word " * 200)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["doc_prefix"]).fetchall()
    assert ("en/b", 2, 7500) in want and (None, 7, 7303) in want and ("a/b/c", 3, 7203) in want and not any(w[0] == "en/a" for w in want)
    columns = ["doc", "n_chunks", "n_tokens"]
    assert plain([tuple(r) for r in QUERIES["doc_prefix"](spark, str(tmp_path)).select(columns).collect()], columns) == plain(want, columns)

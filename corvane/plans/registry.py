"""Where queries and their SQL twins are registered, and SQL fragments that several twins use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
HASH = "('0x' || substr(md5({}), 1, 12))::BIGINT"
DOCS_SQL = f"SELECT doc_id, text, lang, source, len({WORDS.format('text')})::BIGINT AS n FROM documents"


def rounded_sql(sql: str, *columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM ({sql})"

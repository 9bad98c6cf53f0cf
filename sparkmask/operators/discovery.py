"""Read-only SQL over Parquet tables: text guards, then a look at the parsed plan, which no trick of spelling gets round."""

from __future__ import annotations

import base64
import datetime
import re

from pyspark.sql import DataFrame, SparkSession

from ..errors import MaskError

LEADERS = ("SELECT", "WITH", "VALUES", "TABLE", "FROM")
BANNED = frozenset(
    "INSERT UPDATE DELETE MERGE CREATE DROP ALTER TRUNCATE GRANT REVOKE ATTACH DETACH COPY EXPORT IMPORT PRAGMA SET RESET INSTALL LOAD CALL VACUUM CHECKPOINT USE CACHE UNCACHE REFRESH ANALYZE MSCK REPAIR ADD".split()
)
FUNCTIONS = re.compile(r"\b(?:read_\w+|java_method|reflect|try_reflect|input_file_name|scan_\w+|glob)\s*\(", re.I)
PATH_TABLE = re.compile(r"\b(?:FROM|JOIN)\s+(?:'|\"|`|(?:csv|json|parquet|orc|text|avro|binaryFile|delta)\s*\.)", re.I)


def strip_comments(sql: str) -> str:
    """The statement without comments; quoted text is left as it is."""
    return re.sub(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", sql, flags=re.S)


def guard(sql: str) -> str:
    """The one read-only statement of a text, or an error."""
    text = strip_comments(sql or "").strip()
    text = text.rstrip(";").rstrip()
    if not text:
        raise MaskError("sql_empty")
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if ";" in bare:
        raise MaskError("sql_multiple_statements")
    words = re.findall(r"[A-Za-z_]\w*", bare)
    if not words or words[0].upper() not in LEADERS:
        raise MaskError("sql_not_a_query", words[0] if words else "")
    if bad := next((w for w in words if w.upper() in BANNED), None):
        raise MaskError("sql_banned_word", bad)
    if m := FUNCTIONS.search(bare):
        raise MaskError("sql_banned_function", m[0])
    if m := PATH_TABLE.search(text):
        raise MaskError("sql_path_table", m[0])
    return text


def check_plan(spark: SparkSession, sql: str, tables: set[str]) -> None:
    """Refuses commands, and relations other than the given views and the query's own CTEs."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise MaskError("sql_failed", str(e).split("\n")[0]) from None
    text = plan.toString()
    ctes = {m.lower() for m in re.findall(r"CTE \[([^\]]*)\]", text) for m in re.split(r",\s*", m)}
    for name in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", text):
        if name.lower() not in tables and name.lower() not in ctes:
            raise MaskError("sql_unknown_relation", name)
    if any(k in text for k in ("InsertInto", "'Create", "SetCommand", "'Drop", "AddJar", "AddFile")):
        raise MaskError("sql_not_a_query", "command")


def run_sql(spark: SparkSession, sql: str, tables: dict[str, str | DataFrame], row_limit: int = 10_000) -> DataFrame:
    """The query's rows, `row_limit` at most, over views of the given tables (paths of Parquet files, or DataFrames).

    Paths are views of a session of their own, so callers' views are neither seen nor changed; DataFrames belong to
    their session and are views of it for the query.
    """
    text = guard(sql)
    own = spark.newSession() if all(isinstance(t, str) for t in tables.values()) else spark
    check_plan(own, text, {t.lower() for t in tables})
    for name, t in tables.items():
        (own.read.parquet(t) if isinstance(t, str) else t).createOrReplaceTempView(name)
    try:
        out = own.sql(text)
        out.schema  # analysis errors come here
    except Exception as e:
        raise MaskError("sql_failed", str(e).split("\n")[0]) from None
    return out.limit(row_limit)


def plain(value):
    """A result value as JSON takes it."""
    if isinstance(value, datetime.date | datetime.datetime | datetime.time):
        return value.isoformat()
    if isinstance(value, bytes | bytearray):
        try:
            return bytes(value).decode()
        except UnicodeDecodeError:
            return base64.b16encode(bytes(value)).decode().lower()
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return value if isinstance(value, str | int | float | bool | type(None)) else str(value)


def rows(df: DataFrame) -> list[dict]:
    """The limited result as dictionaries."""
    return [{k: plain(v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()]

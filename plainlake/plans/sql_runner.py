"""Read-only SQL over a set of tables, in the analytic dialect of `dialect`."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from plainlake.plans.dialect import DialectError, parse, to_spark

#: Plan nodes of statements that write or change something; they are refused wherever they stand.
WRITES = ("Command", "InsertInto", "CreateTable", "CreateView", "CreateNamespace", "DropTable", "DropView", "ReplaceTable", "MergeInto", "DeleteFrom", "UpdateTable", "AlterTable", "TruncateTable", "SetCatalog", "UseNamespace", "CacheTable")


class ReadOnlyError(ValueError):
    pass


def check_read_only(text: str, translated: str, spark: SparkSession) -> None:
    """Refuses all but one SELECT or WITH statement. The parsed plan is looked at too: a WITH may lead an INSERT."""
    nodes = parse(text)
    if not nodes or nodes[0].word not in ("SELECT", "WITH"):
        raise ReadOnlyError("only SELECT and WITH statements may run")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(translated)
    lines = [re.sub(r"^[\s:+\-']*", "", line) for line in plan.treeString().splitlines()]
    if bad := next((line for line in lines if line.startswith(WRITES)), None):
        raise ReadOnlyError(f"the statement would write: {bad.split()[0]}")


def run_sql(text: str, tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """The rows of a read-only statement over `tables`; none is read unless it is named.

    The tables are temporary views only while the statement is analysed: afterwards the session's views are as before, so
    one set of tables never sees another's. Where a length is asked of a list, the text is read again with that meaning."""
    text = text.strip().rstrip(";")
    nodes = parse(text)
    if not nodes or nodes[0].word not in ("SELECT", "WITH"):
        raise ReadOnlyError("only SELECT and WITH statements may run")
    translated = to_spark(text)
    before = {n: spark.table(n) if spark.catalog.tableExists(n) else None for n in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        check_read_only(text, translated, spark)
        try:
            return spark.sql(translated)
        except AnalysisException:
            if "CAST(length(" not in translated:
                raise
            return spark.sql(translated.replace("CAST(length(", "CAST(cardinality("))
    finally:
        for name, df in before.items():
            spark.catalog.dropTempView(name)
            if df is not None and not spark.catalog.tableExists(name):
                df.createOrReplaceTempView(name)


__all__ = ["DialectError", "ReadOnlyError", "check_read_only", "run_sql", "to_spark"]

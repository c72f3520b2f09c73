"""The read-only check on submitted SQL: a text pattern for logs, Spark's own parser
for texts that are going to run."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, SparkSession, functions as F

# fixed values: the refused words
FORBIDDEN = ["CREATE", "DROP", "ALTER", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "GRANT", "REVOKE", "MERGE"]

# literals and comments, whichever starts first; their words do not count. In a raw
# literal a back-slash is a plain character.
SKIPPED = (r"(?s)\b[rR]'[^']*'|\b[rR]\"[^\"]*\"|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\""
           r"|--[^\n]*|/\*.*?\*/")
FORBIDDEN_WORD = r"(?is)\b(?:" + "|".join(FORBIDDEN) + r")\b"

# fixed values: functions that leave SQL, functions of FROM that read no file, and the
# statements other than queries that only look
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer",
                   "stack", "json_tuple", "variant_explode", "variant_explode_outer"}
LOOKING = {"ShowTables", "ShowColumns", "ShowFunctions", "DescribeRelation", "DescribeQueryCommand", "DescribeFunction"}


class NotReadOnly(ValueError):
    pass


def check_read_only(sql: str | None) -> str:
    """Return the text, or raise when it is empty or names a refused word."""
    if not sql or not sql.strip():
        raise NotReadOnly("empty SQL")
    hit = re.search(FORBIDDEN_WORD, re.sub(SKIPPED, " ", sql))
    if hit:
        raise NotReadOnly(f"{hit.group(0).upper()} is not allowed in a read-only query")
    return sql


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _expressions(expression) -> Iterator:
    yield expression
    for child in _all(expression.children()):
        yield from _expressions(child)


def _nodes(plan) -> Iterator:
    """Every node of a parsed plan, those in common table expressions and subqueries too."""
    yield plan
    for more in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for child in _all(more):
            yield from _nodes(child)


def check_plan(spark: SparkSession, sql: str, tables: Iterable[str]) -> None:
    """Raise unless the text, as Spark parses it, is a query over the given tables and
    its own common table expressions only."""
    java = spark._jvm.java.lang.Class
    command = java.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    statement = java.forName("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    root = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    known = {t.lower() for t in tables}
    nodes = list(_nodes(root))
    for node in nodes:
        if node.getClass().getSimpleName() == "UnresolvedWith":
            known |= {str(pair._1()).lower() for pair in _all(node.cteRelations())}
    for node in nodes:
        name = node.getClass().getSimpleName()
        if name in LOOKING:
            continue
        if (command.isInstance(node) or statement.isInstance(node) or name.startswith(("InsertInto", "Script"))
                or "UnresolvedIdentifier" in name or name == "CompoundBody"):
            raise NotReadOnly(f"{name} is not allowed in a read-only query")
        if name == "UnresolvedRelation":
            parts = [str(p) for p in _all(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in known:
                raise NotReadOnly(f"no such table: {'.'.join(parts)}")
        if name == "UnresolvedTableValuedFunction":
            if str(node.name().apply(node.name().size() - 1)).lower() not in TABLE_FUNCTIONS:
                raise NotReadOnly("this function of FROM is not allowed")
        for expression in _all(node.expressions()):
            for part in _expressions(expression):
                kind = part.getClass().getSimpleName()
                if kind == "UnresolvedFunction" and str(_all(part.nameParts())[-1]).lower() in REFUSED_FUNCTIONS:
                    raise NotReadOnly("this function is not allowed in a read-only query")


def gate(sql: Column) -> Column:
    """``ok``, ``empty`` or ``forbidden`` for each text of a query log."""
    return (F.when(F.trim(F.coalesce(sql, F.lit(""))) == "", "empty")
            .when(F.regexp_replace(sql, SKIPPED, " ").rlike(FORBIDDEN_WORD), "forbidden")
            .otherwise("ok"))

"""Read-only ad-hoc SQL over the model's tables."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.fixed_values import FORBIDDEN_FUNCTIONS, FORBIDDEN_WORDS

_LEADING_COMMENTS = re.compile(r"(?:\s+|--[^\n]*(?:\n|$)|/\*.*?(?:\*/|$))*", re.DOTALL)
_WITH = re.compile(r"WITH(?:\s+RECURSIVE)?\b", re.IGNORECASE)
_FORBIDDEN = re.compile(
    r"\b(" + "|".join(FORBIDDEN_WORDS + FORBIDDEN_FUNCTIONS) + r")\b", re.IGNORECASE
)


class RefusedQueryError(ValueError):
    """The text is not a single read-only query."""


def check_sql(text: str) -> str:
    """The query without trailing semicolons; raises `RefusedQueryError` if it is not allowed.

    One SELECT or WITH statement, possibly after comments. Forbidden words are
    refused wherever they stand, also inside literals.
    """
    query = text.strip().rstrip(";")
    if ";" in query:
        raise RefusedQueryError("more than one statement")
    body = query[_LEADING_COMMENTS.match(query).end():]
    if not body.upper().startswith(("SELECT", "WITH")):
        raise RefusedQueryError(f"only SELECT and WITH queries are allowed, got {body[:20]!r}")
    found = _FORBIDDEN.search(query)
    if found:
        raise RefusedQueryError(f"forbidden word {found[1].upper()}")
    return query


#: What a query's parse tree may be made of. Table functions, names computed by IDENTIFIER, scripts, time travel
#: and statements are none of these.
_KNOWN_NODES = frozenset(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset "
    "OneRowRelation Pivot Project Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable "
    "UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith Unpivot WithWindowDefinition".split()
)
_SUBQUERY = "org.apache.spark.sql.catalyst.expressions.PlanExpression"


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def read_relations(spark: SparkSession, query: str) -> set[str]:
    """Names a query reads, without those that stand for its own common table expressions where they stand.

    The nodes of Spark's own parse tree are walked, subqueries included; nothing is resolved. A node that is not
    known, a name computed at run time, a name of several parts and a function that is not built in are refused.
    """
    state = spark._jsparkSession.sessionState()
    fold = str if state.conf().caseSensitiveAnalysis() else str.lower
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    builtin = catalyst.analysis.FunctionRegistry.builtin()
    read: set[str] = set()

    def kind(node) -> str:
        return node.getClass().getSimpleName().rstrip("$")

    def expression(node, scope: frozenset[str]) -> None:
        name = kind(node)
        if name == "ExpressionWithUnresolvedIdentifier":
            raise RefusedQueryError("names computed by IDENTIFIER are not allowed")
        if name == "UnresolvedFunction":
            parts = _items(node.nameParts())
            if len(parts) > 1 or not builtin.functionExists(catalyst.FunctionIdentifier(parts[0])):
                raise RefusedQueryError(f"not a function that may be used: {'.'.join(parts)}")
        if is_instance_of(spark.sparkContext._gateway, node, _SUBQUERY):
            plan(node.plan(), scope)
        for child in _items(node.children()):
            expression(child, scope)

    def plan(node, scope: frozenset[str]) -> None:
        name = kind(node)
        if name not in _KNOWN_NODES:
            raise RefusedQueryError(f"{name} is not allowed in a query")
        if name == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) > 1:
                raise RefusedQueryError(f"not among the tables given: {'.'.join(parts)}")
            if fold(parts[0]) not in scope:
                read.add(parts[0])
        if name == "UnresolvedWith":
            for cte in _items(node.cteRelations()):
                own = scope | {fold(cte._1())}
                # A definition sees those before it, and itself if it may be recursive.
                plan(cte._2(), own if node.allowRecursion() else scope)
                scope = own
        for part in _items(node.expressions()):
            expression(part, scope)
        for child in _items(node.children()):
            plan(child, scope)

    plan(state.sqlParser().parsePlan(query), frozenset())
    return read


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A checked query that may read ``tables`` and nothing else. Nothing is collected.

    The tables are common table expressions before the query, over views of names no one else has, so views
    and tables of the session are neither read nor changed.
    """
    query = check_sql(text)
    known = {name.lower() for name in tables}
    foreign = sorted(name for name in read_relations(spark, query) if name.lower() not in known)
    if foreign:
        raise RefusedQueryError(f"not among the tables given: {', '.join(foreign)}")
    given = []
    for name, table in tables.items():
        view = f"ledgerloom_{uuid.uuid4().hex}"
        table.createOrReplaceTempView(view)
        given.append(f"`{name}` AS (SELECT * FROM {view})")
    body = query[_LEADING_COMMENTS.match(query).end():]
    if not given:
        return spark.sql(query)
    own = _WITH.match(body)
    if own is None:
        return spark.sql(f"WITH {', '.join(given)} {body}")
    return spark.sql(f"{own[0]} {', '.join(given)}, {body[own.end():]}")


@dataclass
class SqlOutcome:
    """What a query gave: its columns and rows, or the error as a value."""

    columns: list[str] = field(default_factory=list)
    result: DataFrame | None = None
    error: str | None = None

    def rows(self) -> DataFrame | None:
        """Each row as one JSON text."""
        return None if self.result is None else json_rows(self.result)

    def row_count(self) -> int:
        return 0 if self.result is None else self.result.count()

    def table(self, spark: SparkSession) -> DataFrame:
        """The outcome as rows: each row as JSON with the columns, the row count and the error.

        An outcome without rows is one row whose ``row`` is NULL. The count is a scalar subquery, so no row
        is gathered for it.
        """
        if self.result is None:
            return spark.createDataFrame([(None, "", 0, self.error)], "row string, columns string, row_count long, error string")
        rows = self.rows()
        counted = rows.agg(F.count("*").alias("row_count"))
        nothing = counted.filter("row_count = 0").select(F.lit(None).cast("string").alias("row"), "row_count")
        answered = rows.withColumn("row_count", counted.scalar()).unionByName(nothing)
        known = [F.lit(",".join(self.columns)).alias("columns"), F.lit(None).cast("string").alias("error")]
        return answered.select("row", known[0], "row_count", known[1])


def execute_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> SqlOutcome:
    """Like :func:`run_sql`, with refusals and Spark's complaints about the query as a value."""
    try:
        result = run_sql(spark, text, tables)
    except (RefusedQueryError, PySparkException) as problem:
        return SqlOutcome(error=str(problem).splitlines()[0])
    return SqlOutcome(result.columns, result)


def json_rows(result: DataFrame) -> DataFrame:
    """Each row as one JSON text: decimals as numbers, dates in ISO form, nesting kept."""
    return result.select(
        F.to_json(F.struct(*result.columns), {"ignoreNullFields": "false"}).alias("row")
    )

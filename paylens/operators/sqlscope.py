"""X-5 … X-7: checked, merchant-scoped execution of one SELECT statement.

The statement is analysed in an isolated session whose only temporary view is
``transactions``, the merchant's rows.  What runs is decided on the analysed
plan, in which Spark has resolved every name in its scope: each leaf must be
that very view, literal rows or a common table expression of the statement
itself, each operator and each function must be one of those listed or grouped
below.  Catalog tables, files, global views, table functions, scripts, user
functions and functions that reach outside their arguments are refused, however
they are named or quoted.  The frame that was checked is the one returned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens import schemas

_CATALYST = "org.apache.spark.sql.catalyst"

OPERATORS = frozenset({
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct", "Deduplicate",
    "Join", "LateralJoin", "Union", "Except", "Intersect", "SubqueryAlias", "Window", "Generate", "Expand", "Sample",
    "WithCTE", "CTERelationDef", "ResolvedHint"})
LEAVES = frozenset({"OneRowRelation", "LocalRelation", "CTERelationRef"})
#: Expressions without a function name of their own, and what functions with builders turn into.
EXPRESSIONS = frozenset({
    "Alias", "AttributeReference", "OuterReference", "Literal", "Cast", "CaseWhen", "If", "SortOrder", "UnaryMinus",
    "AggregateExpression", "WindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame", "UnboundedPreceding",
    "UnboundedFollowing", "CurrentRow", "ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery",
    "LambdaFunction", "NamedLambdaVariable", "With", "CommonExpressionDef", "CommonExpressionRef", "GetStructField",
    "GetArrayItem", "GetArrayStructFields", "GetMapValue", "TimestampAddInterval", "TimestampAddYMInterval",
    "SubtractTimestamps", "SubtractDates", "DatetimeSub", "PivotFirst", "DateAddInterval", "DateAddYMInterval", "MultiplyYMInterval", "MultiplyDTInterval",
    "DivideYMInterval", "DivideDTInterval", "InSet", "LikeAll", "LikeAny", "NotLikeAll", "NotLikeAny", "Explode", "PosExplode",
    "Inline", "Ceil", "Floor", "RoundCeil", "RoundFloor", "Percentile", "PercentileCont", "PercentileDisc", "Mode", "ListAgg",
    "StringLPad", "StringRPad", "Contains", "StartsWith", "EndsWith", "GetTimestamp", "Rank", "DenseRank", "RowNumber"})
#: Groups of Spark's built-in functions that work on their arguments alone.
FUNCTION_GROUPS = frozenset({
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs",
    "string_funcs", "struct_funcs", "window_funcs"})


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


@functools.lru_cache(maxsize=4)
def _allowed_functions(jvm) -> frozenset[str]:
    """Class names of the built-in functions of ``FUNCTION_GROUPS`` (a builder is named after what it builds)."""
    infos = (entry._2()._1() for entry in _items(jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.expressions()))
    return frozenset(i.getClassName().removesuffix("ExpressionBuilder") for i in infos if i.getGroup() in FUNCTION_GROUPS)


class _Check:
    """Walks an analysed plan; collects its literals, raises at what is not allowed."""

    def __init__(self, jvm, table: str):
        self.table = table
        self.functions = _allowed_functions(jvm)
        self.inherits = jvm.java.lang.Class.forName(f"{_CATALYST}.expressions.InheritAnalysisRules")
        self.literals: set[str] = set()

    def plan(self, node) -> None:
        kind, name = _kind(node), node.getClass().getName()
        if kind == "View" and node.isTempView() and node.desc().identifier().database().isEmpty() \
                and node.desc().identifier().table() == self.table:
            return  # the isolated session has one temporary view, the merchant's rows
        leaf = node.children().isEmpty()
        if not name.startswith(f"{_CATALYST}.plans.logical.") or kind not in (LEAVES if leaf else OPERATORS):
            raise ValueError(f"{kind} is outside the merchant's scope")
        for expr in _items(node.expressions()):
            self.expression(expr)
        for child in _items(node.children()):
            self.plan(child)

    def expression(self, expr) -> None:
        kind, name = _kind(expr), expr.getClass().getName().rstrip("$")
        if not (name in self.functions or kind in EXPRESSIONS and name.startswith(f"{_CATALYST}.expressions.")):
            raise ValueError(f"function {expr.prettyName()} is not allowed")
        if kind == "Literal":
            self.literals.add(str(expr.value()))
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            self.plan(expr.plan())
        for child in _items(expr.parameters() if self.inherits.isInstance(expr) else expr.children()):
            self.expression(child)


def isolated(tx: DataFrame, merchant_id: str, table: str = "transactions") -> SparkSession:
    """A session of its own, with the caller's settings, in which ``table`` is the merchant's rows and files are no tables."""
    spark = tx.sparkSession
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    own = tx.filter(F.col("merchant_id") == merchant_id)
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, own._jdf.logicalPlan())
    rows.createOrReplaceTempView(table)
    return session


def check_sql(spark: SparkSession, sql: str, merchant_id: str, table: str = "transactions", tx: DataFrame | None = None) -> DataFrame:
    """The statement's frame over the merchant's rows of ``tx`` (none given: an empty table), or ValueError naming what is refused."""
    text = sql.strip().rstrip(";").rstrip()
    session = isolated(spark.createDataFrame([], schemas.TRANSACTIONS) if tx is None else tx, merchant_id, table)
    try:
        session._jsparkSession.sessionState().sqlParser().parsePlan(text)
        found = session.sql(f"SELECT * FROM (\n{text}\n)")  # in parentheses only a query is a statement: nothing runs here
    except ParseException as e:
        raise ValueError(f"only one SELECT statement is run: {e.getCondition() or 'parse error'}") from None
    except AnalysisException as e:
        raise ValueError(f"outside the merchant's scope: {e.getCondition() or 'analysis error'}") from None
    check = _Check(session._jvm, table)
    check.plan(found._jdf.queryExecution().analyzed())
    if merchant_id not in check.literals:
        raise ValueError("the statement does not name its merchant")
    return found


def run_scoped_sql(spark: SparkSession, sql: str, merchant_id: str, tx: DataFrame, table: str = "transactions") -> DataFrame:
    """SRC-11 name binding: every reference to ``table`` reads the merchant's rows of ``tx`` only."""
    return check_sql(spark, sql, merchant_id, table, tx)

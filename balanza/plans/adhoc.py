"""Guarded ad-hoc SELECT surface over published views.

A statement is analysed in a session of its own that knows the published views and no other,
and that opens no files by name. What is checked is the analysed plan of the very DataFrame
that then runs: each of its nodes and expressions must be on a list of plain relational ones.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

DEFAULT_ROWS = 50
MAX_ROWS = 100

VIEWS = ["dim_cooperativa", "dim_cuenta", "fact_indicadores"]

#: Nodes of a plan that a statement may have. A view is one only if it is published; what it is made of is not looked at.
PLANS = set(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join Union Distinct Intersect Except Window
    SubqueryAlias OneRowRelation View WithCTE CTERelationDef CTERelationRef""".split()
)

#: Expressions that a statement may use. Whatever else Spark knows, now or later, is refused: calls
#: of JVM code, user functions, generators, readers of files and of the session.
EXPRESSIONS = set(
    """AttributeReference OuterReference Alias Literal TypedNullLiteral SortOrder Cast With CommonExpressionDef CommonExpressionRef
    Add Subtract Multiply Divide IntegralDivide Remainder Pmod UnaryMinus UnaryPositive Abs Round BRound Ceil Floor
    RoundCeil RoundFloor CeilExpressionBuilder FloorExpressionBuilder Sqrt Exp Log Log10 Log2 Logarithm Pow Signum
    CheckOverflow PromotePrecision
    EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual And Or Not In InSet Between
    IsNull IsNotNull IsNaN Like LikeAll LikeAny NotLikeAll NotLikeAny ILike RLike Contains StartsWith EndsWith
    CaseWhen If Coalesce NullIf Nvl Nvl2 NaNvl Greatest Least
    Upper Lower Length Substring Left Right Concat ConcatWs StringTrim StringTrimLeft StringTrimRight StringTrimBoth
    StringReplace StringInstr StringLocate InitCap RegExpReplace RegExpExtract StringLPad StringRPad Reverse
    Year Quarter Month DayOfMonth DayOfWeek DayOfYear WeekOfYear DateAdd DateSub DateDiff AddMonths MonthsBetween
    LastDay TruncDate DateFormatClass ParseToDate GetTimestamp CurrentDate MakeDate DatePart Extract
    ExtractANSIIntervalDays DateAddInterval DateAddYMInterval
    AggregateExpression Count CountIf Sum Average Min Max MinBy MaxBy StddevSamp StddevPop VarianceSamp VariancePop
    Corr CovSample CovPopulation Median Percentile PercentileCont PercentileDisc First Last BoolAnd BoolOr
    Skewness Kurtosis
    WindowExpression WindowSpecDefinition SpecifiedWindowFrame RowFrame$ RangeFrame$ UnspecifiedFrame$ CurrentRow$
    UnboundedPreceding$ UnboundedFollowing$ RowNumber Rank DenseRank PercentRank CumeDist NTile Lag Lead NthValue
    ScalarSubquery Exists ListQuery InSubquery""".split()
)
_SPARK = "org.apache.spark.sql.catalyst."
#: Settings of the asking session that change results or sizes of tasks.
_KEPT = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions")


class NotAllowed(ValueError):
    """The statement is not a SELECT over the published views."""


def safe_limit(requested) -> int:
    """Row cap: absent, zero, ALL or not a number gives the default; large numbers the maximum."""
    text = "" if requested is None else str(requested).strip()
    count = int(text) if text.isascii() and text.isdigit() else 0
    return min(count, MAX_ROWS) if count > 0 else DEFAULT_ROWS


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def column_catalogue(spark: SparkSession, views=VIEWS) -> DataFrame:
    """Published views and their columns, as rows for analysts."""
    rows = [(v, f.name, f.dataType.simpleString()) for v in views for f in spark.table(v).schema.fields]
    return spark.createDataFrame(rows, "vista string, columna string, tipo string")


def closed_session(spark: SparkSession, views=VIEWS) -> SparkSession:
    """A session of the same application whose only temporary views are ``views``, as ``spark`` has them now.

    It has no user functions, and a path in the place of a table is not one.
    """
    closed = spark.newSession()
    for name in _KEPT:
        closed.conf.set(name, spark.conf.get(name))
    closed.conf.set("spark.sql.runSQLOnFiles", "false")
    for view in views:
        # Views that all sessions see carry the tables over; they, too, are refused by the check under these names.
        spark.table(view).createOrReplaceGlobalTempView(f"published_{view}")
        closed.table(f"global_temp.published_{view}").createOrReplaceTempView(view)
    return closed


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    """The class of a plan node or expression; the full name if it is none of Spark's own."""
    name = node.getClass().getName()
    return name.rpartition(".")[2] if name.startswith(_SPARK) else name


def _check_expression(expression, views: set[str]) -> None:
    kind = _kind(expression)
    if kind not in EXPRESSIONS:
        raise NotAllowed(f"not allowed in a statement: {kind}")
    if kind in ("ScalarSubquery", "Exists", "ListQuery"):
        _check_plan(expression.plan(), views)
    for child in _items(expression.children()):
        _check_expression(child, views)


def _check_plan(plan, views: set[str]) -> None:
    kind = _kind(plan)
    if kind not in PLANS:
        raise NotAllowed(f"only the published views can be read, not {kind}")
    if kind == "View":
        name = plan.desc().identifier()
        if name.database().isDefined() or name.table().lower() not in views:
            raise NotAllowed(f"only the published views can be read, not {name.unquotedString()}")
        return
    for expression in _items(plan.expressions()):
        _check_expression(expression, views)
    for child in _items(plan.children()):
        _check_plan(child, views)


def check_allowed(df: DataFrame, views=VIEWS) -> None:
    """Refuse a DataFrame whose analysed plan has a node or expression that is not on the lists, or reads other views."""
    _check_plan(df._jdf.queryExecution().analyzed(), {v.lower() for v in views})


def adhoc(spark: SparkSession, query: str, limit=None, views=VIEWS) -> DataFrame:
    """Run one SELECT over ``views`` with a row cap. The cap sits on the result, so inner LIMITs stay as written.

    A trailing LIMIT of the statement is the requested cap unless ``limit`` is given.
    """
    statement = query.strip().rstrip(";").strip()
    # Commands run when they are analysed; nothing that begins so is one.
    if not re.match(r"SELECT\b", statement, re.IGNORECASE):
        raise NotAllowed("only SELECT statements are allowed")
    trailing = re.search(r"\bLIMIT\s+(\w+)\s*$", statement, re.IGNORECASE)
    if trailing:
        statement = statement[: trailing.start()]
        limit = trailing.group(1) if limit is None else limit
    df = closed_session(spark, views).sql(statement)
    check_allowed(df, views)
    return df.limit(safe_limit(limit))


def try_adhoc(spark: SparkSession, query: str, limit=None, views=VIEWS) -> DataFrame:
    """Like ``adhoc``, but a refused or failing statement gives one row with its error."""
    try:
        return adhoc(spark, query, limit, views)
    except (NotAllowed, PySparkException) as problem:
        return spark.createDataFrame([(str(problem).splitlines()[0],)], "error string")

"""Column expressions: ratios, bands, text and date helpers. No Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from balanza.constants import MONTHS_ES, NEUTRAL_SCORE, PROVINCES

_COMPARE = {
    ">=": lambda v, c: v >= c,
    ">": lambda v, c: v > c,
    "<": lambda v, c: v < c,
    "<=": lambda v, c: v <= c,
}


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero(c) -> Column:
    """Null counts as zero."""
    return F.coalesce(as_col(c), F.lit(0.0))


def safe_ratio(num, den, scale: float = 100.0) -> Column:
    """``num / den * scale`` where the denominator is positive, else null."""
    num, den = as_col(num), as_col(den)
    ratio = num / den
    return F.when(den > 0, ratio if scale == 1 else ratio * F.lit(float(scale)))


def half_up(c, digits: int) -> Column:
    """Half-up decimal rounding, returned as double."""
    return F.round(as_col(c).cast("decimal(38,10)"), digits).cast("double")


def band_score(c, comparison: str, cuts, scores, otherwise: float, missing: float = NEUTRAL_SCORE) -> Column:
    """First matching cut decides the score; a missing value is neutral."""
    v, test = as_col(c), _COMPARE[comparison]
    steps = F.when(v.isNull(), F.lit(float(missing)))
    for cut, score in zip(cuts, scores, strict=True):
        steps = steps.when(test(v, F.lit(float(cut))), F.lit(float(score)))
    return steps.otherwise(F.lit(float(otherwise)))


def clamp(c, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), as_col(c)))


def clean_text(c) -> Column:
    """Trim blanks, then surrounding double quotes."""
    return F.btrim(F.trim(as_col(c)), F.lit('"'))


#: Balances keep four decimals; the type holds 34 digits before them.
AMOUNT = "decimal(38,4)"


def _number(c) -> Column:
    text = F.replace(F.trim(as_col(c)), F.lit(","), F.lit("."))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text).try_cast(AMOUNT)


def is_amount(c) -> Column:
    """Whether a text is one plain number, with decimal comma or point, that a balance can hold."""
    return _number(c).isNotNull()


def parse_amount(c) -> Column:
    """Decimal comma or point; anything that is not one plain number counts as 0 (``is_amount`` tells which)."""
    return F.coalesce(_number(c), F.lit(0).cast(AMOUNT))


DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "yyyyMMdd")


def parse_date(c, formats=DATE_FORMATS) -> Column:
    """First format that parses wins; a time part after a blank or T is ignored; else null."""
    text = F.regexp_replace(clean_text(c), r"[ T]\d{1,2}:.*$", "")
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def province(ruc) -> Column:
    """Province of a tax number; null if its first two digits are none's."""
    names = F.array(*[F.lit(n) for n in PROVINCES])
    code = F.substring(as_col(ruc), 1, 2).try_cast("int")
    return F.when(code.between(1, len(PROVINCES)), F.element_at(names, F.greatest(code, F.lit(1))))


def short_name(c) -> Column:
    """Entity name without the legal prefix and suffix, in title case."""
    name = F.regexp_replace(as_col(c), r"COOPERATIVA DE AHORRO Y CR[EÉ]DITO\s*", "")
    name = F.regexp_replace(name, r"LIMITADA|LTDA\.?", "")
    return F.initcap(F.trim(name))


def short_label(c) -> Column:
    """Segment label for chart axes. Case-sensitive, so upper-case labels pass unchanged."""
    whole = F.replace(as_col(c), F.lit("Segmento 1 Mutualista"), F.lit("Mutualista"))
    return F.replace(whole, F.lit("Segmento "), F.lit("Seg. "))


def truncate(c, width: int = 28) -> Column:
    return F.substring(as_col(c), 1, width)


def month_label(c, style: str = "iso") -> Column:
    """``iso`` 2026-04, ``short`` Apr2026, ``es`` Abr 2026."""
    d = as_col(c)
    if style == "iso":
        return F.date_format(d, "yyyy-MM")
    if style == "short":
        return F.date_format(d, "MMMyyyy")
    if style == "es":
        names = F.array(*[F.lit(m) for m in MONTHS_ES])
        return F.concat_ws(" ", F.element_at(names, F.month(d)), F.year(d).cast("string"))
    raise ValueError(f"unknown month style: {style}")


def next_months(c, n: int) -> Column:
    """Array of the next ``n`` yyyy-MM labels."""
    first = F.trunc(as_col(c), "MM")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.date_format(F.add_months(first, i), "yyyy-MM"))


def month_ends(c, n: int) -> Column:
    """Array of the ``n`` month-ends after the month of a date."""
    first = F.trunc(as_col(c), "MM")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.last_day(F.add_months(first, i)))


def stars(p) -> Column:
    p = as_col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def limit_text(kind, limit, unit) -> Column:
    """``≥9%`` or ``≤5%``."""
    limit = as_col(limit)
    number = F.when(limit == F.floor(limit), F.floor(limit).cast("string")).otherwise(limit.cast("string"))
    return F.concat(F.when(as_col(kind) == "mayor", "≥").otherwise("≤"), number, as_col(unit))


def breaches(value, kind, limit) -> Column:
    """A ``mayor`` limit is broken from below, a ``menor`` limit from above."""
    v, limit = as_col(value), as_col(limit)
    return F.when(as_col(kind) == "mayor", v < limit).otherwise(v > limit)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# Wichura's AS 241 coefficients (constant term first) for the normal quantile.
_AS241 = {
    "central": (
        (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
         4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
         2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    ),
    "middle": (
        (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
         1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
         1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    "tail": (
        (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
         2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
         7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
}


def _polynomial(x: Column, coefficients) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def _rational(x: Column, region: str) -> Column:
    top, bottom = _AS241[region]
    return _polynomial(x, top) / _polynomial(x, bottom)


def with_normal_quantile(df: DataFrame, p: Column, out: str) -> DataFrame:
    """Add the inverse standard normal distribution of ``p`` (0 < p < 1), natively.

    The arguments of the rational functions are columns of their own, so that generated code
    evaluates each once instead of once per polynomial term.
    """
    staged = df.withColumn("_p", p).withColumn("_q", F.col("_p") - F.lit(0.5))
    staged = staged.withColumns(
        {
            "_c": F.lit(0.180625) - F.col("_q") * F.col("_q"),
            "_r": F.sqrt(-F.ln(F.when(F.col("_q") <= 0, F.col("_p")).otherwise(F.lit(1.0) - F.col("_p")))),
        }
    ).withColumns({"_r1": F.col("_r") - F.lit(1.6), "_r2": F.col("_r") - F.lit(5.0)})
    q, r = F.col("_q"), F.col("_r")
    outer = F.when(r <= 5, _rational(F.col("_r1"), "middle")).otherwise(_rational(F.col("_r2"), "tail"))
    value = F.when(F.abs(q) <= 0.425, q * _rational(F.col("_c"), "central")).otherwise(F.signum(q) * outer)
    return staged.withColumn(out, value).drop("_p", "_q", "_c", "_r", "_r1", "_r2")

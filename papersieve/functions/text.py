"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def latin1(content: Column) -> Column:
    """Bytes as text with one character per byte; lossless both ways."""
    return F.decode(content, "ISO-8859-1")


def utf8_of(text: Column) -> Column:
    """A slice of the byte-per-character view read as UTF-8, bad bytes dropped."""
    raw = F.encode(text, "ISO-8859-1").cast("string")
    return F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` for ``body`` so that it is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), lambda bound: body(bound)), 1)


def literals(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def case_map(key: Column, pairs: Sequence[tuple], default: Column | None = None) -> Column:
    """``CASE key WHEN k THEN v ...`` over a fixed list of pairs."""
    out = None
    for k, v in pairs:
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def rank_of(value: Column, order: Sequence[str]) -> Column:
    """Position of ``value`` in a fixed order, null when it is not listed."""
    return case_map(value, [(v, i) for i, v in enumerate(order)])


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def clip(value: Column, limit: int) -> Column:
    """Struct of the clipped text and whether anything was cut."""
    return F.struct(
        F.left(value, F.lit(limit)).alias("text"),
        (F.length(value) > limit).alias("truncated"),
    )


def count_of(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed text; 0 for the empty one."""
    if not needle:
        return F.lit(0)
    removed = F.replace(haystack, F.lit(needle), F.lit(""))
    return ((F.length(haystack) - F.length(removed)) / len(needle)).cast("int")


def safe_text(value: Column, limit: int | None = 512) -> Column:
    """Printable form: NUL dropped, control characters as dots, clipped unless ``limit`` is None."""
    no_nul = F.replace(value, F.lit("\x00"), F.lit(""))
    dotted = F.regexp_replace(no_nul, r"[\p{C}\p{Z}&&[^ \n\t]]", ".")
    shown = F.coalesce(dotted, F.lit(""))
    return shown if limit is None else F.left(shown, F.lit(limit))


def attempt(value: Column) -> Column:
    """``value``, or null where evaluating it fails.

    This is the expression behind the ``try_`` functions, which has no name of its
    own in Python. Where the session gives no access to it (a remote client), the
    value is returned unguarded.
    """
    if not hasattr(value, "_jc"):
        return value
    jvm = SparkSession.active()._jvm
    columns = jvm.org.apache.spark.sql.classic.ExpressionUtils
    guarded = jvm.org.apache.spark.sql.catalyst.expressions.TryEval(columns.expression(value._jc))
    return Column(columns.column(guarded))


def redact(mapping: Column, keys: Sequence[str] = ("api_key", "token")) -> Column:
    """Mask the values of sensitive keys in a string map."""
    return F.transform_values(
        mapping, lambda k, v: F.when(k.isin(*keys), F.lit("***")).otherwise(v)
    )


def take(array: Column, limit: int) -> Column:
    return F.slice(array, 1, limit)

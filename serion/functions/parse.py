"""Number tokens, complex numbers as text, sensor lines and file names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
REAL = rf"^[+-]?{_NUMBER}$"
_SPLIT = rf"^([+-]?{_NUMBER}(?=[+-]))?([+-]?(?:{_NUMBER})?)[ij]$"


def tokens(text: Column) -> Column:
    """Tokens of free-form text: commas count as white space."""
    return F.filter(F.split(F.translate(text, ",", " "), r"\s+"), lambda x: x != "")


def parse_number(token: Column) -> Column:
    """struct<re, im> of ``a``, ``bj`` or ``a+bj`` (i or j), in parentheses or not; null if it is none of them.

    Names such as inf and nan are no numbers.
    """
    token = F.regexp_replace(token, r"^\((.*)\)$", "$1")
    re = F.regexp_extract(token, _SPLIT, 1)
    im = F.regexp_extract(token, _SPLIT, 2)
    im = F.when(im.isin("", "+"), F.lit("1")).when(im == "-", F.lit("-1")).otherwise(im)
    as_complex = F.struct(F.coalesce(F.expr("double(0)") * 0 + re.try_cast("double"), F.lit(0.0)).alias("re"), im.try_cast("double").alias("im"))
    as_real = F.struct(token.try_cast("double").alias("re"), F.lit(0.0).alias("im"))
    return F.when(token.rlike(REAL), as_real).when(token.rlike(_SPLIT), as_complex)


def number_kind(value: Column) -> Column:
    """complex, real or skipped."""
    return F.when(value.isNull(), "skipped").when(value["im"] != 0, "complex").otherwise("real")


def complex_text(value: Column) -> Column:
    """``(re+imj)`` with ten decimals; null stays null."""
    return F.when(value.isNotNull(), F.format_string("(%.10f%s%.10fj)", value["re"], F.when(value["im"] < 0, "-").otherwise("+"), F.abs(value["im"])))


def sensor_value(line: Column) -> Column:
    """Degrees of a line such as ``Core 0:  +47.0°C  (high = ...)``; null without any."""
    return F.regexp_extract(line, r":\s*\+?(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def file_name(prefix: str, t_max: Column, run: Column, ending: str) -> Column:
    """``prefix_T{t_max}_{run}.ending`` with t_max without decimals."""
    return F.format_string(f"{prefix}_T%.0f_%s.{ending}", t_max, run)

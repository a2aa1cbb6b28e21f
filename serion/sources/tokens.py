"""A table function over free-form text: every token with its place, its type and, if it is no number, the reason."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_REAL = re.compile(rf"[+-]?{_NUMBER}")
_COMPLEX = re.compile(rf"([+-]?{_NUMBER}(?=[+-]))?([+-]?(?:{_NUMBER})?)[ij]")
_TOKEN = re.compile(r"[^ \t\r\f\x0B,]+")
_NAME = re.compile(r"[+-]?(?:inf|infinity|nan)", re.I)
#: What the function returns: name and type.
FIELDS = (("line", IntegerType()), ("field", IntegerType()), ("token", StringType()), ("kind", StringType()), ("re", DoubleType()), ("im", DoubleType()), ("reason", StringType()))


def typed(token: str) -> tuple[str, float | None, float | None, str | None]:
    """(kind, re, im, reason): real, complex or skipped; one pair of parentheses is taken off."""
    bare = token[1:-1] if len(token) > 1 and token[0] == "(" and token[-1] == ")" else token
    if _REAL.fullmatch(bare):
        return "real", float(bare), 0.0, None
    if m := _COMPLEX.fullmatch(bare):
        im = float(m[2] + "1") if m[2] in ("", "+", "-") else float(m[2])
        return ("complex" if im else "real"), float(m[1] or 0), im, None
    if not bare:
        return "skipped", None, None, "nothing in parentheses"
    return "skipped", None, None, "name of a number" if _NAME.fullmatch(bare) else "no number"


class _NumberTokens:
    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError(f"number tokens are read from text, not from {text.dataType.simpleString()}")
        return AnalyzeResult(schema=StructType([StructField(*f) for f in FIELDS]))

    def eval(self, text: str | None) -> Iterator[tuple]:
        for line, said in enumerate((text or "").split("\n"), 1):
            for field, token in enumerate(_TOKEN.findall(said), 1):
                yield (line, field, token, *typed(token))


number_tokens = udtf(_NumberTokens)


def with_tokens(df: DataFrame, text: str) -> DataFrame:
    """df's rows, one for each token of the text (none for a null or blank one), without a shuffle."""
    column: Column = F.col(text).outer()
    return df.lateralJoin(number_tokens(column))

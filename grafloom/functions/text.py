"""Column functions over text: lines, snippets, paths, byte-bounded cuts, summaries."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Text = Column | str


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(text: Text) -> Column:
    """Lines of a text without their ends; a final line end opens no further line, an empty text has none."""
    t = F.regexp_replace(_col(text), r"\r\n", "\n")
    t = F.when(F.endswith(t, F.lit("\n")), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.when(F.length(_col(text)) == 0, F.array().cast("array<string>")).otherwise(F.split(t, "\n"))


def slice_lines(text: Text, start: Column | int, end: Column | int) -> Column:
    """Lines start to end, from 1 and inclusive, joined; clamped to the text; empty if start is after end."""
    a = F.greatest(start if isinstance(start, Column) else F.lit(start), F.lit(1)).cast("int")
    b = (end if isinstance(end, Column) else F.lit(end)).cast("int")
    return F.when(a > b, F.lit("")).otherwise(F.array_join(F.slice(lines(text), a, F.greatest(b - a + 1, F.lit(0))), "\n"))


def find_pattern(df: DataFrame, text: str, pattern: Column | str, context: int, *keep: str, first_line: Column | int = 1) -> DataFrame:
    """Lines around every line that contains a literal: keep, match_no (from 1), number, content.

    Each hit brings ``context`` lines on either side, clamped to the text; hits that lie
    close repeat lines.  ``first_line`` is the number of the text's first line.
    """
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    base = first_line if isinstance(first_line, Column) else F.lit(first_line)
    hits = F.filter(F.transform("__lines", lambda x, i: F.when(F.contains(x, p), i)), lambda i: i.isNotNull())
    one = df.withColumn("__lines", F.split(_col(text), "\n")).select(*keep, base.alias("__base"), "__lines", F.posexplode(hits).alias("__m", "__hit"))
    first, last = F.greatest(F.col("__hit") - context, F.lit(0)), F.least(F.col("__hit") + context, F.size("__lines") - 1)
    near = one.select(*keep, (F.col("__m") + 1).alias("match_no"), "__base", "__lines", F.explode(F.sequence(first, last)).alias("__at"))
    return near.select(*keep, "match_no", (F.col("__base") + F.col("__at")).cast("long").alias("number"), F.get("__lines", F.col("__at")).alias("content"))


def path_base(path: Text) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)/*$", 1)


def path_ext(path: Text) -> Column:
    """From the last dot of the base on; empty without one."""
    return F.regexp_extract(_col(path), r"(\.[^./]*)$", 1)


def path_stem(path: Text) -> Column:
    return F.regexp_replace(path_base(path), r"\.[^.]*$", "")


@F.pandas_udf(T.StringType())
def path_join(folder: pd.Series, rest: pd.Series) -> pd.Series:
    """Folder and path joined, with . and .. resolved."""
    return pd.Series([None if a is None or b is None else posixpath.normpath(posixpath.join(a, b)) for a, b in zip(folder, rest, strict=True)], dtype=object)


def cut_bytes(text: Text, most: int, ending: str = "") -> Column:
    """At most ``most`` bytes of a text, whole characters, with ``ending`` if something was cut."""
    c = _col(text)
    prefixes = [F.substring(c.cast("binary"), 1, max(most - k, 0)).cast("string") for k in range(4)]
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(F.coalesce(*[F.when(F.is_valid_utf8(x), x) for x in prefixes]), F.lit(ending)))


def regex_full(column: Text, pattern: str) -> Column:
    """Whether the pattern matches the whole value."""
    return F.rlike(_col(column), F.lit(rf"\A(?:{pattern})\z"))

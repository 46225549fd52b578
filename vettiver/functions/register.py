"""The functions that SQL has no expression for, by name."""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vettiver.functions.text import compatible

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


@F.udtf(returnType="pos int, term string")
class Terms:
    """The terms of a text with their positions; none of null."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(WORD.findall((text or "").casefold()))


def register_functions(spark: SparkSession) -> None:
    """Register ``nfkc_fold(text)``, the table function ``terms_of(text)``, and SQL functions made of expressions.

    ``tokenize(text)`` gives the terms as an array, ``collapse_blanks(text)`` single blanks, ``share_matched(asked, shown)``
    the share of the terms of one array that match a term of another, as evidence is matched.
    """
    spark.udf.register("nfkc_fold", compatible)
    spark.udtf.register("terms_of", Terms)
    blank = "[\\\\t-\\\\r\\\\x1c-\\\\x20\\\\x85\\\\xa0\\\\u1680\\\\u2000-\\\\u200a\\\\u2028\\\\u2029\\\\u202f\\\\u205f\\\\u3000]+"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tokenize(t STRING) RETURNS ARRAY<STRING> RETURN coalesce(regexp_extract_all(replace(lower(t), 'ß', 'ss'), '[\\\\p{L}\\\\p{M}\\\\p{N}]+', 0), array())")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION collapse_blanks(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, '{blank}', ' '))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION share_matched(asked ARRAY<STRING>, shown ARRAY<STRING>) RETURNS DOUBLE RETURN CASE WHEN size(asked) = 0 THEN 0D ELSE "
        "size(filter(asked, a -> exists(shown, b -> a = b OR (least(length(a), length(b)) >= 4 AND (contains(a, b) OR contains(b, a)))))) / size(asked) END"
    )

"""Text functions as Column expressions."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, of two characters or more, without stop words."""
    words = F.split(F.lower(text), "[^a-z0-9_]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*fixed.STOP_WORDS))


def token_rows(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """A row for each token, made and filtered inside one generated stage."""
    rows = df.select(*keep, F.explode(F.split(F.regexp_replace(text, "[^A-Za-z0-9_]+", " "), " ")).alias("token")).withColumn("token", F.lower("token"))
    return rows.where((F.length("token") > 1) & ~F.col("token").isin(*fixed.STOP_WORDS))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized(text: Column) -> Column:
    return F.lower(collapsed(text))


def qgrams(text: Column, q: int = 3) -> Column:
    """Distinct character q-grams of the normalized text, padded by a blank at both ends."""
    padded = F.concat(F.lit(" "), normalized(text), F.lit(" "))
    return F.when(F.length(padded) < q, F.array(padded)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substring(padded, i, F.lit(q)))))


def lines(text: Column) -> Column:
    """Lines at every line boundary; a boundary at the end begins no further line."""
    return F.split(F.regexp_replace(text, "(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])$", ""), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.trim(text), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("record"))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references decoded, those by number too; no-break spaces are blanks."""
    return texts.map(lambda x: None if x is None else unescape(x).replace("\xa0", " "))


def stripped_html(text: Column) -> Column:
    """Tags to blanks, character references decoded, white space collapsed."""
    return collapsed(unescaped(F.regexp_replace(text, "<[^>]+>", " ")))


#: References that the driver's tables hold, for SQL: what ends in no semicolon is one too. The ampersand comes last, so that nothing is decoded twice.
ENTITIES = (("&nbsp;?", " "), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "'"), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&"))


def symbol_name(symbol: Column) -> Column:
    """The last word of a symbol, without the path before it and marks around it."""
    s = F.regexp_replace(F.regexp_replace(F.trim(symbol), r"(?s)^.* ", ""), r"(?s)^.*/", "")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^[`#().;:,]+|[`#().;:,]+$", ""), F.lit("")), F.lit("graph symbol"))


def relation_kind(is_reference: Column, is_implementation: Column, is_type: Column, is_definition: Column) -> Column:
    return F.when(is_reference, "reference").when(is_implementation, "implementation").when(is_type, "type-definition").when(is_definition, "definition").otherwise("relationship")


def trimmed(text: Column, limit: int = 180) -> Column:
    one = collapsed(text)
    return F.when(one == "", None).when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.left(one, F.lit(limit - 1))), F.lit("…")))


def title(text: Column) -> Column:
    return F.left(F.split_part(text, F.lit(". "), F.lit(1)), F.lit(96))


def timestamp(*values: Column) -> Column:
    """The first value that is epoch seconds or an ISO time."""
    found = [F.coalesce(F.timestamp_micros((v.try_cast("double") * 1_000_000).cast("bigint")), F.try_to_timestamp(v)) for v in values]
    return F.coalesce(*found)


def patch_paths(patch: Column) -> Column:
    """Paths that a unified diff writes to, in order, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ b/(.*)$"), F.lit(1)), lambda p: p != "/dev/null"))


def summary(text: Column, limit: int = 600) -> Column:
    """The first paragraph, collapsed."""
    return F.left(collapsed(F.split_part(F.trim(text), F.lit("\n\n"), F.lit(1))), F.lit(limit))


def decision_name(value: Column) -> Column:
    return F.element_at(F.split(F.lower(F.trim(value)), r"\."), -1)


def first_text(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])

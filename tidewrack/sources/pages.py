"""Pages from files: the bytes of each, the charset that it declares, and its text."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A charset is declared in so many first bytes; a page without one has this.
HEAD, USUAL = 2048, "utf-8"


def declared_charset(content: Column) -> Column:
    """The name after the first charset= of a page's head, in small letters; the usual one without any."""
    head = F.decode(F.substring(content, F.lit(1), F.lit(HEAD)), "ISO-8859-1")
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(head, r"""(?i)charset\s*=\s*["']?\s*([\w.:-]+)""", 1)), F.lit("")), F.lit(USUAL))


@F.pandas_udf(StringType())
def decoded(content: pd.Series, charset: pd.Series) -> pd.Series:
    """Text of bytes; an unknown charset is read as the usual one, and what can't be read becomes U+FFFD."""
    def one(raw: bytes | None, name: str | None) -> str | None:
        if raw is None:
            return None
        try:
            known = codecs.lookup(name or USUAL)
            # some names are of other things than texts
            return known.decode(raw, "replace")[0] if known._is_text_encoding else raw.decode(USUAL, "replace")
        except LookupError:
            return raw.decode(USUAL, "replace")

    return pd.Series([one(raw, name) for raw, name in zip(content, charset, strict=True)], dtype=object)


def with_text(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds charset and html; null bytes have no text."""
    return df.withColumn("charset", declared_charset(F.col(content))).withColumn("html", decoded(F.col(content), F.col("charset")))


def read_pages(spark: SparkSession, path: str, names: str = "*.html") -> DataFrame:
    """path, charset, html of each file below a folder whose name fits; an empty file has no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    return with_text(files.select("path", "content")).select("path", "charset", "html")

"""What the text operators share: words, carried columns, shared folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.session import shared_path

# Blanks as the contracts define them: space and the five ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the one that driver and executors share; discard_written deletes it."""
    return shared_path(spark, name)


def words_of(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def carried(df: DataFrame, *made: str) -> list[str]:
    """Input columns that an operator passes on: all but those it makes itself, in any case."""
    taken = {name.lower() for name in made}
    return [name for name in df.columns if name.lower() not in taken]


def boxed(df: DataFrame, *made: str) -> Column:
    """The carried columns as one struct, out of the way of an operator's working columns."""
    return F.struct(*[F.col(f"`{name}`") for name in carried(df, *made)])

"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import session

# A word is a run of code points other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for the row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_hash(*parts: Column) -> Column:
    """A double in [0, 1) that depends on the parts alone: 52 bits of an MD5 over them."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


# Tasks that one stage is cut into at most.
MOST_TASKS = 4096


def fresh(name: str, *columns: str) -> str:
    """A column name that none of the given columns bears."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def dealt(rows: DataFrame, most: int = MOST_TASKS) -> DataFrame:
    """A written table of rows that each stand for much work (a file, a block of one), dealt out to as many
    tasks as there are rows, but no more than ``most``. A number of partitions is named so that adaptive execution, which sees
    only the bytes of the rows, doesn't join them into one task."""
    return rows.repartition(min(most, max(1, rows.count())))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back. Nobody reads the shuffle files behind it again, so Spark is
    told to remove them when it is written, as far as it knows the setting; the setting is put back."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    if before is None:
        return session.materialised(df, name)
    conf.set(CLEANUP, "true")
    try:
        return session.materialised(df, name)
    finally:
        conf.set(CLEANUP, before)

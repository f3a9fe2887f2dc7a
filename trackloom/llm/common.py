"""Helpers shared by the corpus operators."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space that separates words: space and \t \n \v \f \r, which is
# also what bytes.split() splits on.
BLANKS = " \t\n\x0b\f\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound an Arrow batch by bytes, so that very long texts come few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    return spark


def sampled(rows: DataFrame, column: str, wanted: int, total: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, by a hash of ``column``. The share is cut
    at 62 bits, so that it stays above 0 for any table."""
    bound = max(int(min(1.0, wanted / max(total, 1)) * (1 << 62)), 1)
    return rows.where(F.pmod(F.xxhash64(column), F.lit(1 << 62)) < F.lit(bound))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores in front until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def content_key(*columns: str) -> Column:
    """Digest of a row's columns; equal rows share it, nulls included. Counts of
    characters in front keep different rows from running together."""
    parts = []
    for c in columns:
        parts += [F.coalesce(F.char_length(F.col(c).cast("string")).cast("string"), F.lit("~")), F.lit(":"),
                  F.coalesce(F.col(c).cast("string"), F.lit(""))]
    return F.md5(F.concat(*parts))


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of every text of a batch; null is empty."""
    found = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
    return [x or b"" for x in found]


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    found = batch.column(batch.schema.get_field_index(column)).to_pylist()
    return [x or "" for x in found]

"""Parquet (or any file format) reader with a column contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mountwait.contracts import CONTRACTS, conform


def read_table(spark: SparkSession, path: str, contract=None, fmt: str = "parquet") -> DataFrame:
    """Whole-table scan.  ``contract`` is a ``StructType`` or a name in
    ``contracts.CONTRACTS``; when given the columns are checked and cast."""
    df = spark.read.format(fmt).load(path)
    if contract is None:
        return df
    if isinstance(contract, str):
        contract = CONTRACTS[contract]
    return conform(df, contract)

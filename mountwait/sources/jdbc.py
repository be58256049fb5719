"""JDBC sources.

``numPartitions`` with ``lowerBound``/``upperBound`` only sets the stride of
the per-partition range queries: rows outside the bounds are still read
(they land in the first or last partition).  Bounds are therefore taken from
the table itself (``min``/``max`` pushed to the database) unless given, so
that partitions are even; they are never used as a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mountwait.sources.shards import depth_predicates

DEFAULT_FETCH_SIZE = 10_000


def _opts(url: str, properties: dict | None, fetch_size: int) -> dict:
    # Zone-less database times stay zone-less, whatever zone the JVM runs in.
    o = {"url": url, "fetchsize": str(fetch_size), "preferTimestampNTZ": "true"}
    o.update({k: str(v) for k, v in (properties or {}).items()})
    return o


def quote(spark: SparkSession, url: str, name: str) -> str:
    """An identifier quoted the way Spark's JDBC dialect for ``url`` does."""
    return spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)


def read_jdbc_grouped(spark: SparkSession, url: str, table: str, by: str,
                      aggregates: dict[str, str], *, properties: dict | None = None) -> DataFrame:
    """``select by, agg... from table group by by`` computed by the database
    (a derived table): only one row per group crosses the connection.
    ``aggregates`` maps output names to ``"count"`` or ``"<fn>:<column>"``
    (``fn`` one of min, max, sum)."""
    q_by = quote(spark, url, by)
    parts = []
    for out, spec in aggregates.items():
        if spec == "count":
            parts.append(f"count(*) as {quote(spark, url, out)}")
        else:
            fn, col = spec.split(":", 1)
            if fn not in ("min", "max", "sum"):
                raise ValueError(f"unsupported aggregate {fn!r}")
            parts.append(f"{fn}({quote(spark, url, col)}) as {quote(spark, url, out)}")
    q = f"select {q_by}, {', '.join(parts)} from {table} group by {q_by}"
    return read_jdbc_query(spark, url, q, properties=properties)


def jdbc_bounds(spark: SparkSession, url: str, table: str, column: str,
                properties: dict | None = None) -> tuple[int, int]:
    """``(min, max)`` of ``column``, computed by the database (one row).

    The column is quoted the way Spark's JDBC dialect for ``url`` quotes it
    (tables written by Spark keep their lower-case names quoted)."""
    quoted = quote(spark, url, column)
    q = f"select min({quoted}) as lo, max({quoted}) as hi from {table}"
    row = (spark.read.format("jdbc").options(**_opts(url, properties, DEFAULT_FETCH_SIZE))
           .option("query", q).load().first())
    lo, hi = row[0], row[1]
    return (int(lo) if lo is not None else 0, int(hi) if hi is not None else 0)


def read_jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None,
              num_partitions: int | None = None, lower: int | None = None,
              upper: int | None = None, properties: dict | None = None,
              fetch_size: int = DEFAULT_FETCH_SIZE, equal_depth: bool = False) -> DataFrame:
    """Whole-table scan; range-partitioned on ``column`` when it is given.

    ``equal_depth`` cuts the ranges at the column's quantiles instead of equal strides: the
    column alone is read first (by strides), sketched, and the ranges go to the database as
    one condition per partition.

    Filters and projections applied to the result are pushed to the
    database by Spark's JDBC source.
    """
    r = spark.read.format("jdbc").options(**_opts(url, properties, fetch_size)).option("dbtable", table)
    if equal_depth and column and num_partitions and num_partitions > 1:
        ids = read_jdbc(spark, url, table, column=column, num_partitions=num_partitions, properties=properties,
                        fetch_size=fetch_size).select(column)
        o = _opts(url, properties, fetch_size)
        return spark.read.jdbc(o.pop("url"), table, properties=o,
                               predicates=depth_predicates(ids, column, num_partitions, quote(spark, url, column)))
    if column and num_partitions and num_partitions > 1:
        if lower is None or upper is None:
            lo, hi = jdbc_bounds(spark, url, table, column, properties)
            lower = lo if lower is None else lower
            upper = hi + 1 if upper is None else upper
        r = (r.option("partitionColumn", column).option("lowerBound", str(lower))
             .option("upperBound", str(upper)).option("numPartitions", str(num_partitions)))
    return r.load()


def read_jdbc_query(spark: SparkSession, url: str, query: str, *, column: str | None = None,
                    num_partitions: int | None = None, lower: int | None = None,
                    upper: int | None = None, properties: dict | None = None,
                    fetch_size: int = DEFAULT_FETCH_SIZE) -> DataFrame:
    """Scan of a derived table (e.g. an aggregate computed by the database);
    range-partitioned on its ``column`` when given, as ``read_jdbc`` is."""
    if column and num_partitions and num_partitions > 1:
        return read_jdbc(spark, url, f"({query}) mw_query", column=column, num_partitions=num_partitions,
                         lower=lower, upper=upper, properties=properties, fetch_size=fetch_size)
    return (spark.read.format("jdbc").options(**_opts(url, properties, fetch_size))
            .option("query", query).load())

"""Tables in PostgreSQL, MySQL, SQL Server or SQLite, and parameterised SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# JDBC URL forms and default ports. The driver jar must be on the class path.
_URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "sqlite": "jdbc:sqlite:{database}",
}
_PORTS = {"postgresql": 5432, "mysql": 3306, "sqlserver": 1433}


def jdbc_url(config: dict) -> str:
    kind = config.get("type", "sqlite").lower()
    if kind not in _URLS:
        raise ValueError(f"unsupported database type: {kind}")
    return _URLS[kind].format(host=config.get("host", "localhost"),
                              port=config.get("port", _PORTS.get(kind)),
                              database=config["database"])


def jdbc_table(spark: SparkSession, config: dict, table: str,
               partition_column: str | None = None, bounds: tuple | None = None,
               partitions: int = 64, fetch_size: int = 10_000) -> DataFrame:
    """A database table or ``(query) alias``; filters and column choice are pushed to it.

    With a partition column and its bounds the read is split into ranges; without, the whole
    table comes through one connection.
    """
    reader = (spark.read.format("jdbc").option("url", jdbc_url(config))
              .option("dbtable", table).option("fetchsize", fetch_size))
    for option in ("user", "password", "driver"):
        if config.get(option):
            reader = reader.option(option, config[option])
    if partition_column:
        lower, upper = bounds
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", partitions))
    return reader.load()


def run_query(spark: SparkSession, query: str, params: dict | list | None = None) -> DataFrame:
    """SQL over registered views with named (``:p``) or positional (``?``) parameters."""
    return spark.sql(query, args=params) if params else spark.sql(query)

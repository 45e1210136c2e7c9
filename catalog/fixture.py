"""The billing view derived from the driver's tables (FIXTURES.md section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aforo.session import configure

CONSUMO_SQL = """
SELECT o.o_custkey AS codcon,
       o.o_custkey * 100 + l.l_suppkey % (1 + o.o_custkey % 13) AS codudu,
       c.c_nationkey AS coddis, n.n_name AS nomdis,
       CAST(101 + l.l_partkey % 5 AS STRING) AS codcat,
       CONCAT('CAT_', CAST(101 + l.l_partkey % 5 AS STRING)) AS nomcat,
       CASE WHEN o.o_custkey % 3 = 1 THEN '2'
            WHEN (YEAR(l.l_shipdate) * 12 + MONTH(l.l_shipdate) < 1996 * 12 + o.o_custkey % 48)
                 = (o.o_custkey % 3 = 0) THEN '1'
            ELSE '2' END AS situdu,
       c.c_nationkey * 1.5E0 AS coorpx, n.n_regionkey * 2.5E0 AS coorpy,
       CASE WHEN l.l_linenumber = 7 AND l.l_quantity <= 5 THEN 0E0 ELSE l.l_quantity END AS volfac,
       l.l_extendedprice * 0.01E0 AS imagua,
       l.l_extendedprice * 0.01E0 * l.l_discount AS imalca,
       l.l_tax * 100E0 AS imcafi,
       CAST(10 + 2 * l.l_linenumber AS DOUBLE) AS hoxdia,
       CAST(1 + l.l_orderkey % 7 AS DOUBLE) AS diasem,
       CAST(1 + l.l_orderkey % 3 AS INT) AS codtis, l.l_returnflag AS codmof,
       CAST(YEAR(l.l_shipdate) AS INT) AS nuanio, CAST(MONTH(l.l_shipdate) AS INT) AS nummes
FROM {lineitem} l
JOIN {orders} o   ON l.l_orderkey  = o.o_orderkey
JOIN {customer} c ON o.o_custkey   = c.c_custkey
JOIN {nation} n   ON c.c_nationkey = n.n_nationkey
"""

ORACLE_CONSUMO = CONSUMO_SQL.format(lineitem="lineitem", orders="orders", customer="customer", nation="nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def consumo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One billing record per row, straight from the tables, no hints."""
    configure(spark)
    tables = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation")}
    return spark.sql(CONSUMO_SQL, **tables)

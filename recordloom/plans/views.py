"""Systems to synchronise, simulated over the given tables; the same SQL text runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "crm": "SELECT c_custkey AS k, 'crm-' || c_custkey AS external_id, lower(c_name) || '@x.test' AS email, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, (c_custkey * 7) % 1000 AS ts, (c_custkey * 5) % 500 AS created, c_nationkey AS nation FROM customer WHERE c_custkey % 3 <> 0",
    "erp": "SELECT c_custkey AS k, 'erp-' || c_custkey AS external_id, upper(c_name) || '@X.TEST  ' AS email, upper(c_name) AS name, lower(c_mktsegment) AS segment, round(c_acctbal, 0) AS balance, (c_custkey * 11) % 1000 AS ts, (c_custkey * 3) % 500 AS created, cast(c_custkey AS varchar(20)) AS tax_id FROM customer WHERE c_custkey % 3 <> 1",
    "hr": "SELECT c_custkey AS k, 'hr-' || c_custkey AS external_id, cast(c_custkey AS varchar(20)) AS tax_id, c_name AS name FROM customer WHERE c_custkey % 5 = 0",
    "crm_t1": "SELECT k, external_id, email, name, segment, CASE WHEN k % 10 = 0 THEN balance + 1 ELSE balance END AS balance, ts, created, nation FROM crm WHERE k % 17 <> 0",
    "ids": "SELECT 'crm' AS connector, external_id, 'c' || k AS canonical_id FROM crm UNION ALL SELECT 'erp', external_id, 'c' || k FROM erp UNION ALL SELECT 'hr', external_id, 'c' || k FROM hr",
    "facts": "SELECT 'c' || k AS entity, 'segment' AS field, segment AS val, ts, 'crm' AS src, created FROM crm UNION ALL SELECT 'c' || k, 'segment', segment, ts, 'erp', created FROM erp UNION ALL SELECT 'c' || k, 'balance', cast(cast(round(balance, 0) AS bigint) AS varchar(30)), ts, 'crm', created FROM crm UNION ALL SELECT 'c' || k, 'balance', cast(cast(balance AS bigint) AS varchar(30)), ts, 'erp', created FROM erp UNION ALL SELECT 'c' || k, 'name', CASE WHEN k % 4 = 0 THEN NULL ELSE name END, ts, 'crm', created FROM crm UNION ALL SELECT 'c' || k, 'name', name, ts, 'erp', created FROM erp",
    "lines": "SELECT l_orderkey, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS bigint) AS line_no, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount FROM lineitem",
}
NEEDS = {"crm": [], "erp": [], "hr": [], "crm_t1": ["crm"], "ids": ["crm", "erp", "hr"], "facts": ["crm", "erp"], "lines": []}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def with_views(sql: str, *names: str) -> str:
    """DuckDB text: the views as common table expressions before a query."""
    todo: list[str] = []
    for n in names:
        todo += [x for x in [*NEEDS[n], n] if x not in todo]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in todo) + " " + sql if todo else sql


class Source:
    """Tables and views of one folder as DataFrames, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                text = VIEWS[name].replace("varchar(20)", "string").replace("varchar(30)", "string")
                used = [t for t in (*TABLES, *VIEWS) if t != name and f" {t}" in text.replace("\n", " ") and f"FROM {t}" in text]
                self.made[name] = self.spark.sql(text if not used else _bound(text, used), **{t: self[t] for t in used})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.made[name]

    def nested_orders(self) -> DataFrame:
        """Orders with their lines as an array of structs, in line order."""
        from pyspark.sql import functions as F

        line = F.struct("line_no", F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("qty"), F.round("l_extendedprice", 2).alias("price"))
        return self["lines"].groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines")).withColumnRenamed("l_orderkey", "order_id")


def _bound(text: str, used: list[str]) -> str:
    import re

    for t in used:
        text = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", text)
    return text

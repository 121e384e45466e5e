"""A graph of jobs derived from the order tables, and a history that differs from it by fixed rules.

Nodes R, N, P (region, nation, part) are Always, C, S (customer, supplier) Ephemeral, O (orders) Output. Edges follow the
foreign keys. By keys: hash changed at multiples of 7, no history at 11, output absent at 13, failed at 17.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookloom.plans.tables import dealt, spread, written

#: (letter, table, key, kind, columns that make a node's hash)
NODES = [
    ("R", "region", "r_regionkey", "Always", ["r_regionkey", "r_name"]),
    ("N", "nation", "n_nationkey", "Always", ["n_nationkey", "n_name", "n_regionkey"]),
    ("P", "part", "p_partkey", "Always", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]),
    ("C", "customer", "c_custkey", "Ephemeral", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    ("S", "supplier", "s_suppkey", "Ephemeral", ["s_suppkey", "s_name", "s_nationkey"]),
    ("O", "orders", "o_orderkey", "Output", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
]

SQL = "WITH RECURSIVE " + ",\n".join(
    [
        "nodes AS MATERIALIZED (\n  "
        + "\n  UNION ALL ".join(
            f"SELECT '{x}' || {key} AS job_id, '{kind}' AS kind, CAST({key} AS BIGINT) AS k, md5(concat_ws('|', {', '.join(columns)})) AS hash FROM {table}"
            for x, table, key, kind, columns in NODES
        )
        + ")",
        """edges AS MATERIALIZED (
  SELECT 'R' || n_regionkey AS up, 'N' || n_nationkey AS down FROM nation
  UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
  UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders
  UNION SELECT 'S' || l_suppkey, 'O' || l_orderkey FROM lineitem
  UNION SELECT 'P' || l_partkey, 'O' || l_orderkey FROM lineitem)""",
        "hist_output AS (SELECT job_id, CASE WHEN k % 7 = 0 THEN md5(hash || 'old') ELSE hash END AS hash FROM nodes WHERE k % 11 <> 0)",
        """hist_edge AS MATERIALIZED (
  SELECT up, down, CASE WHEN (u.k + d.k) % 7 = 0 THEN md5(u.hash || 'old') ELSE u.hash END AS hash
  FROM edges JOIN nodes u ON u.job_id = up JOIN nodes d ON d.job_id = down WHERE (u.k + d.k) % 11 <> 0)""",
        "digests AS (SELECT down AS job_id, md5(string_agg(up, chr(10) ORDER BY up)) AS input_digest FROM edges GROUP BY down)",
        "hist_inputs AS (SELECT d.job_id, CASE WHEN k % 7 = 0 THEN md5(input_digest || 'old') ELSE input_digest END AS input_digest FROM digests d JOIN nodes n ON n.job_id = d.job_id WHERE k % 11 <> 0)",
    ]
)


class Derived:
    """The graph's tables, lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        def read(name: str, *columns: str) -> DataFrame:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)

        def edge(df: DataFrame, a: str, up: str, b: str, down: str) -> DataFrame:
            return df.select(F.concat(F.lit(a), F.col(up)).alias("up"), F.concat(F.lit(b), F.col(down)).alias("down"))

        nodes = None
        for x, name, key, kind, columns in NODES:
            own = read(name, *columns).select(F.concat(F.lit(x), F.col(key)).alias("job_id"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("k"), F.md5(F.concat_ws("|", *columns)).alias("hash"))
            nodes = own if nodes is None else nodes.union(own)
        self.nodes, self.spark, self.sf_dir = nodes, spark, sf_dir
        # keys are told apart as numbers, by one shuffle for both kinds of edges
        items = read("lineitem", "l_orderkey", "l_suppkey", "l_partkey")
        ups = F.array(*[F.struct(F.lit(x).alias("x"), F.col(c).cast("long").alias("k")) for x, c in (("S", "l_suppkey"), ("P", "l_partkey"))])

        def steps(items: DataFrame) -> DataFrame:
            return items.select("l_orderkey", F.explode(ups).alias("u")).select("l_orderkey", "u.x", "u.k")

        def named(steps: DataFrame) -> DataFrame:
            return steps.select(F.concat("x", "k").alias("up"), F.concat(F.lit("O"), "l_orderkey").alias("down"))

        others = (
            edge(read("nation", "n_regionkey", "n_nationkey"), "R", "n_regionkey", "N", "n_nationkey")
            .union(edge(read("customer", "c_nationkey", "c_custkey"), "N", "c_nationkey", "C", "c_custkey"))
            .union(edge(read("supplier", "s_nationkey", "s_suppkey"), "N", "s_nationkey", "S", "s_suppkey"))
            .union(edge(read("orders", "o_custkey", "o_orderkey"), "C", "o_custkey", "O", "o_orderkey"))
        )
        self.edges = others.union(named(steps(spread(items, "l_orderkey")).distinct()))
        #: edges without a shuffle, for operators that take rows that repeat as one
        self.edge_rows = others.union(named(steps(items)))
        self.inputs = self.edges.select(F.col("down").alias("job_id"), F.col("up").alias("input_name"), "up")
        self.cur_output = self.nodes.select("job_id", F.col("job_id").alias("output_name"), "hash")

    def stored(self) -> Derived:
        """The graph with nodes and edges as stored tables, for queries that read them several times."""
        return self._with(written(self.nodes, "nodes"), written(self.edges, "edges"))

    def dealt(self) -> Derived:
        """The graph with edges as a stored table that lies by upstream, for queries that join or group them so several times."""
        items, orders = (self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").count() for name in ("lineitem", "orders"))
        return self._with(self.nodes, dealt(self.edge_rows, "edges", "up", 2 * items + orders))

    def _with(self, nodes: DataFrame, edges: DataFrame) -> Derived:
        self.nodes, self.edges = nodes, edges
        self.inputs = self.edges.select(F.col("down").alias("job_id"), F.col("up").alias("input_name"), "up")
        self.cur_output = self.nodes.select("job_id", F.col("job_id").alias("output_name"), "hash")
        return self

    @staticmethod
    def _aged(k: Column, value: Column) -> Column:
        return F.when(k % 7 == 0, F.md5(F.concat(value, F.lit("old")))).otherwise(value)

    @property
    def hist_output(self) -> DataFrame:
        return self.nodes.where("k % 11 <> 0").select("job_id", F.col("job_id").alias("output_name"), self._aged(F.col("k"), F.col("hash")).alias("hash"))

    @property
    def hist_edge(self) -> DataFrame:
        up = self.nodes.select(F.col("job_id").alias("up"), F.col("k").alias("uk"), "hash")
        # the key of a node is its id without the letter: no join with the larger side
        both = F.col("uk") + F.substring("down", 2, 20).cast("long")
        return self.edges.join(up, "up").where(both % 11 != 0).select("up", "down", F.col("up").alias("output_name"), self._aged(both, F.col("hash")).alias("hash"))

    @property
    def present(self) -> DataFrame:
        return self.nodes.where("kind = 'Output' and k % 13 <> 0").select(F.col("job_id").alias("output_name"))

    def aged_digests(self, digests: DataFrame) -> DataFrame:
        k = F.substring("job_id", 2, 20).cast("long")
        return digests.withColumn("k", k).where("k % 11 <> 0").select("job_id", self._aged(F.col("k"), F.col("input_digest")).alias("input_digest"))

    @property
    def outcomes(self) -> DataFrame:
        """(job_id, pass, outcome): ephemerals at multiples of 17 failed, other nodes at multiples of 3 succeeded."""
        outcome = F.when((F.col("kind") == "Ephemeral") & (F.col("k") % 17 == 0), "Failed").when(F.col("k") % 3 == 0, "Success").when(F.col("k") % 5 == 0, "UpstreamFailed")
        return self.nodes.select("job_id", F.lit(1).alias("pass"), outcome.alias("outcome")).where("outcome is not null")


SQL_OUTCOMES = "outcomes AS (SELECT job_id, CASE WHEN kind = 'Ephemeral' AND k % 17 = 0 THEN 'Failed' WHEN k % 3 = 0 THEN 'Success' ELSE 'UpstreamFailed' END AS outcome FROM nodes WHERE (kind = 'Ephemeral' AND k % 17 = 0) OR k % 3 = 0 OR k % 5 = 0)"

"""The domain's tables as views over the driver's test tables, once for Spark and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOCATED_AT = "urn:kg:core#locatedAt"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event places its user at location k until the user's next event; a later signup supersedes, an error is retracted."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "retracted").when(F.lead("event_type").over(w) == "signup", "superseded").otherwise("asserted")
    return e.select(
        F.concat(F.lit("urn:assert:"), F.col("event_id").cast("string")).alias("assertion_id"),
        F.col("event_id").alias("sequence"),
        F.col("user_id").alias("subject_id"),
        F.lit(LOCATED_AT).alias("predicate_iri"),
        F.lit("location").alias("kind"),
        F.get_json_object("props", "$.k").cast("long").alias("object_value"),
        F.col("ts").alias("valid_from"),
        F.when(F.col("event_id") % 97 != 0, F.lead("ts").over(w)).alias("valid_until"),
        status.alias("status"),
        F.col("event_type").alias("source_id"),
        F.when(F.col("event_type") == "signup", F.lag("event_id").over(w)).alias("supersedes"),
        F.col("value").alias("score"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, entity_type, name of customers, suppliers, parts, nations and regions."""
    one = lambda t, key, name, kind: load(spark, sf_dir, t).select(F.concat(F.lit(f"urn:world:entity:{t}-"), F.col(key).cast("string")).alias("entity_id"), F.lit(kind).alias("entity_type"), F.col(name).alias("name"))
    return one("customer", "c_custkey", "c_name", "Person").union(one("supplier", "s_suppkey", "s_name", "Organization")).union(one("part", "p_partkey", "p_name", "Platform")).union(one("nation", "n_nationkey", "n_name", "Location")).union(one("region", "r_regionkey", "r_name", "Location"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, surface: primary names and aliases (a part's brand, a customer's segment)."""
    p, c = load(spark, sf_dir, "part"), load(spark, sf_dir, "customer")
    alias = p.select(F.concat(F.lit("urn:world:entity:part-"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_brand").alias("surface")).union(
        c.select(F.concat(F.lit("urn:world:entity:customer-"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_mktsegment").alias("surface"))
    )
    return entities(spark, sf_dir).select("entity_id", F.col("name").alias("surface")).union(alias)


def part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent: customers and suppliers in nations, nations in regions."""
    key = lambda t, c: F.concat(F.lit(f"{t}-"), F.col(c).cast("string"))
    a = load(spark, sf_dir, "customer").select(key("customer", "c_custkey").alias("child"), key("nation", "c_nationkey").alias("parent"))
    b = load(spark, sf_dir, "supplier").select(key("supplier", "s_suppkey").alias("child"), key("nation", "s_nationkey").alias("parent"))
    c = load(spark, sf_dir, "nation").select(key("nation", "n_nationkey").alias("child"), key("region", "n_regionkey").alias("parent"))
    return a.union(b).union(c)


def subordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree of suppliers: s is subordinate to (s - 1) / 2."""
    return load(spark, sf_dir, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("child"), F.floor((F.col("s_suppkey") - 1) / 2).cast("long").alias("parent"))


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """duplicate, survivor, sequence: chains of customers, of which some were split again."""
    return load(spark, sf_dir, "customer").where("c_custkey % 10 in (3, 4)").select(F.col("c_custkey").alias("duplicate"), (F.col("c_custkey") - 1).alias("survivor"), F.col("c_custkey").alias("sequence"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is an observation: its order is the track, its supplier the sensor, its part the position."""
    measure = lambda n, c, u: F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value"), F.lit(u).alias("unit"))
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("at_time"), F.col("l_suppkey").alias("sensor_id"), F.col("l_partkey").alias("position_id"),
        F.array(measure("quantity", "l_quantity", "kn"), measure("discount", "l_discount", "degree"), measure("tax", "l_tax", "m")).alias("measurements"),
    )


#: The same views for the oracle, each as a common table expression.
SQL = {
    "assertions": """assertions AS (SELECT 'urn:assert:' || event_id AS assertion_id, event_id AS sequence, user_id AS subject_id, 'urn:kg:core#locatedAt' AS predicate_iri, 'location' AS kind,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS object_value, ts AS valid_from, CASE WHEN event_id % 97 <> 0 THEN lead(ts) OVER w END AS valid_until,
        CASE WHEN event_type = 'error' THEN 'retracted' WHEN lead(event_type) OVER w = 'signup' THEN 'superseded' ELSE 'asserted' END AS status, event_type AS source_id,
        CASE WHEN event_type = 'signup' THEN lag(event_id) OVER w END AS supersedes, value AS score FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "entities": """entities AS (SELECT 'urn:world:entity:customer-' || c_custkey AS entity_id, 'Person' AS entity_type, c_name AS name FROM customer UNION ALL SELECT 'urn:world:entity:supplier-' || s_suppkey, 'Organization', s_name FROM supplier
        UNION ALL SELECT 'urn:world:entity:part-' || p_partkey, 'Platform', p_name FROM part UNION ALL SELECT 'urn:world:entity:nation-' || n_nationkey, 'Location', n_name FROM nation UNION ALL SELECT 'urn:world:entity:region-' || r_regionkey, 'Location', r_name FROM region)""",
    "names": """names AS (SELECT entity_id, name AS surface FROM entities UNION ALL SELECT 'urn:world:entity:part-' || p_partkey, p_brand FROM part UNION ALL SELECT 'urn:world:entity:customer-' || c_custkey, c_mktsegment FROM customer)""",
    "part_of": """part_of AS (SELECT 'customer-' || c_custkey AS child, 'nation-' || c_nationkey AS parent FROM customer UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey FROM supplier UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey FROM nation)""",
    "subordinate": "subordinate AS (SELECT s_suppkey AS child, CAST(floor((s_suppkey - 1) / 2.0) AS BIGINT) AS parent FROM supplier WHERE s_suppkey > 0)",
    "merges": "merges AS (SELECT c_custkey AS duplicate, c_custkey - 1 AS survivor, c_custkey AS sequence FROM customer WHERE c_custkey % 10 IN (3, 4))",
    "observations": """observations AS (SELECT l_orderkey AS track_id, l_linenumber AS line, l_shipdate AS at_time, l_suppkey AS sensor_id, l_partkey AS position_id, l_quantity, l_discount, l_tax FROM lineitem)""",
}


def with_views(views: str, sql: str, recursive: bool = False) -> str:
    """SQL over the named views."""
    parts = [SQL[v] for v in views.split()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}"

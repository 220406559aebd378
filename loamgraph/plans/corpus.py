"""The driver's tables seen as source files, links, commits and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXT = {"en": ".py", "fr": ".go", "de": ".md", "es": ".json"}
LANG = {"en": "python", "fr": "go", "de": "markdown", "es": "json"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by(column: str, names: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file_id, path, language, text."""
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), _by("lang", EXT))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), _by("lang", LANG).alias("language"), "text")


FILES_SQL = """
  SELECT doc_id AS file_id, '/corpus/' || source || '/' || lang || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.go' WHEN 'de' THEN '.md' ELSE '.json' END AS path,
    CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'go' WHEN 'de' THEN 'markdown' ELSE 'json' END AS language, text FROM documents"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as touches of documents: path, author, ts (unix seconds)."""
    docs = files(spark, sf_dir).select("file_id", "path")
    n = table(spark, sf_dir, "documents").count()
    e = table(spark, sf_dir, "events").select(F.pmod("event_id", F.lit(n)).alias("file_id"), F.col("user_id").alias("author"), F.unix_timestamp("ts").alias("ts"))
    return e.join(docs, "file_id").select("path", "author", "ts")


COMMITS_SQL = """
  SELECT f.path, e.user_id AS author, epoch(date_trunc('second', e.ts))::BIGINT AS ts FROM events e JOIN files f ON f.file_id = e.event_id % (SELECT count(*) FROM documents)"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier's nation -> customer's nation by return flag."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("target"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("source"))
    return li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").select("source", "target", F.col("l_returnflag").alias("kind")).distinct()


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order -> the customer's next one by key; finished orders also lead back to the one before, so that stretches of them are cycles."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    o = o.withColumn("before", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("before is not null")
    ahead = o.select(F.col("before").alias("source"), F.col("o_orderkey").alias("target"), F.lit("next").alias("kind"))
    return ahead.unionByName(o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source"), F.col("before").alias("target"), F.lit("back").alias("kind")))


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


ORDER_EDGES_SQL = """
  SELECT unnest(CASE WHEN o_orderstatus = 'F' THEN [before, o_orderkey] ELSE [before] END) AS source, unnest(CASE WHEN o_orderstatus = 'F' THEN [o_orderkey, before] ELSE [o_orderkey] END) AS target
  FROM (SELECT o_orderkey, o_orderstatus, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before IS NOT NULL"""


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> supplier for each line, supplier -> customer for each returned one. Customers have even ids, suppliers odd ones."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") * 2).alias("c"))
    q = li.groupBy("l_orderkey", "l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).join(o, "l_orderkey").select("c", (F.col("l_suppkey") * 2 + 1).alias("s"), "l_returnflag").distinct()
    buys = q.select(F.col("c").alias("source"), F.col("s").alias("target"), F.col("l_returnflag").alias("kind"))
    return buys.unionByName(q.filter("l_returnflag = 'R'").select(F.col("s").alias("source"), F.col("c").alias("target"), F.lit("return").alias("kind")))


def purchase_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).cast("long").alias("id"))
    return c.unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).cast("long").alias("id")))


PURCHASES_SQL = """
  SELECT o_custkey * 2 AS source, l_suppkey * 2 + 1 AS target, l_returnflag AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT l_suppkey * 2 + 1, o_custkey * 2, 'return' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as boxes and groups of a canvas for each brand."""
    k = F.col("p_partkey")
    kind = F.when(k % 10 == 0, "group").when(k % 10 == 1, "file").otherwise("text")
    big = F.when(k % 10 == 0, 8).otherwise(1)
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("/maps/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".canvas")).alias("canvas"), k.alias("ord"), F.concat(F.lit("n"), k.cast("string")).alias("id"), kind.alias("type"),
        (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 1000).cast("double").alias("y"), (F.col("p_size") * 2 * big).cast("double").alias("w"), (F.col("p_size") * big + 5).cast("double").alias("h"),
        F.lit(None).cast("string").alias("color"), F.when(kind == "text", F.concat(F.lit("# "), "p_name", F.lit("\n"), "p_type")).alias("text"),
        F.when(kind == "file", F.concat(F.lit("Brand_"), ((k * 7) % 5 + 1).cast("string"), F.lit(".canvas"))).alias("file"), F.when(kind == "file", F.concat(F.lit("#n"), (k + 1).cast("string"))).alias("subpath"),
        F.lit(None).cast("string").alias("url"), F.when(kind == "group", F.col("p_name")).alias("label"))


BOXES_SQL = """
  SELECT '/maps/' || replace(p_brand, '#', '_') || '.canvas' AS canvas, p_partkey AS ord, 'n' || p_partkey AS id,
    CASE p_partkey % 10 WHEN 0 THEN 'group' WHEN 1 THEN 'file' ELSE 'text' END AS type,
    (p_partkey * 37 % 1000)::DOUBLE AS x, (p_partkey * 91 % 1000)::DOUBLE AS y,
    (p_size * 2 * CASE p_partkey % 10 WHEN 0 THEN 8 ELSE 1 END)::DOUBLE AS w, (p_size * CASE p_partkey % 10 WHEN 0 THEN 8 ELSE 1 END + 5)::DOUBLE AS h, p_name, p_type FROM part"""


def box_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections between boxes of neighbouring keys; some name boxes of other canvases and so are dangling."""
    k = F.col("ord")
    b = boxes(spark, sf_dir)
    return b.select("canvas", "ord", F.concat(F.lit("e"), k.cast("string")).alias("id"), F.col("id").alias("from_node"), F.concat(F.lit("n"), (k + F.when(k % 3 == 0, 1).otherwise(25)).cast("string")).alias("to_node"),
                    F.lit(None).cast("string").alias("from_side"), F.lit(None).cast("string").alias("to_side"), F.when(k % 4 == 0, "arrow").alias("from_end"), F.when(k % 5 == 0, "none").alias("to_end"), F.when(k % 7 == 0, "uses").alias("label"))


BOX_EDGES_SQL = """
  SELECT canvas, ord, 'e' || ord AS id, id AS from_node, 'n' || (ord + CASE ord % 3 WHEN 0 THEN 1 ELSE 25 END) AS to_node,
    CASE WHEN ord % 4 = 0 THEN 'arrow' END AS from_end, CASE WHEN ord % 5 = 0 THEN 'none' END AS to_end, CASE WHEN ord % 7 = 0 THEN 'uses' END AS label FROM boxes"""

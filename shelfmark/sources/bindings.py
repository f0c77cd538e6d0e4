"""Catalog tables read from a folder of Parquet tables.

A catalog is three kinds of tables: files, the facts known about them, and the
relations between them. Here they are bound to the driver's tables; a crawl of a
file tree (:mod:`shelfmark.sources.filesystem`) yields files of the same schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths

#: The moment that ages are measured at; never the clock, so results repeat.
AS_OF = 1_700_000_000

FOLDERS = ["Projects/app/src", "Projects/app/node_modules/lib", "Backup/2023", "Personal Details", "Downloads", "Projects/app/target/debug", "Photos/2024", "Projects/web/dist", "Old HDD-Backup/x", "Music/albums", ".cache/tmp", "Designs"]
EXTENSIONS = ["txt", "js", "txt", "pdf", "exe", "o", "jpg", "js", "zip", "mp3", "bin"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files in folders of region, nation and customer."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    folder = F.concat(F.lit("/"), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("/"), F.col("n_name"), F.lit("/"), F.replace("c_name", F.lit("#"), F.lit("_")))
    return joined.select(
        F.col("o_orderkey").alias("file_id"), folder.alias("folder_path"), F.col("o_totalprice").cast("long").alias("size"),
        F.unix_timestamp("o_orderdate").alias("modified_at"), F.col("o_orderpriority").alias("label"),
    )


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, extension, kind, size, times, content hash."""
    i = F.col("doc_id")
    k = (i % 12).cast("int")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), n + 1)
    ext = F.when(k == 11, pick(["psd", "png", "jpg"], F.expr("CAST((doc_id DIV 12) % 3 AS INT)"))).otherwise(pick([*EXTENSIONS, ""], k))
    number = lambda e: F.expr(e).cast("string")
    stem = (
        F.when(k == 11, F.concat(F.lit("doc"), number("doc_id DIV 36")))
        .when(k == 2, F.concat(F.lit("doc"), number("(doc_id - 2) DIV 12"), F.lit(" backup")))
        .when(k == 0, F.concat(F.lit("doc"), number("doc_id DIV 12")))
        .otherwise(F.concat(F.lit("doc"), i.cast("string")))
    )
    files = table(spark, sf_dir, "documents").select(
        i.alias("file_id"), F.concat(F.lit("/corpus/"), pick(FOLDERS, k)).alias("folder_path"), F.concat(stem, F.lit("."), ext).alias("name"), ext.alias("extension"),
        F.col("n_chars").alias("size"), (F.lit(AS_OF) - (i * 7919 * 13) % 94_608_000).alias("modified_at"), F.md5(F.col("text").cast("binary")).alias("content_hash"),
        F.when(i % 17 == 0, F.lit(AS_OF)).alias("deleted_at"),
    )
    return files.withColumn("path", F.concat("folder_path", F.lit("/"), "name")).withColumn("media_kind", paths.media_kind(F.col("extension")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assertions about users."""
    sources = ["user", "extractor:pdf", "rule:r1", "heuristic:h1", "phash", "ml:m1", "system"]
    source = F.element_at(F.array(*[F.lit(s) for s in sources]), (F.col("event_id") % 7).cast("int") + 1)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("key"), F.get_json_object("props", "$.k").alias("value"), source.alias("source"),
        paths.f32(F.least(F.col("value") / 100, F.lit(1.0))).alias("confidence"), F.unix_timestamp("ts").alias("asserted_at"),
    )


#: The same bindings in DuckDB SQL, as common table expressions.
_KINDS = " ".join(f"WHEN extension IN ({', '.join(repr(x) for x in names)}) THEN '{kind}'" for kind, names in paths.MEDIA_KINDS.items())
SQL = {
    "hier_files": """SELECT o_orderkey AS file_id, concat('/', replace(r_name,' ','_'), '/', n_name, '/', replace(c_name,'#','_')) AS folder_path,
  CAST(trunc(o_totalprice) AS BIGINT) AS size, CAST(epoch(o_orderdate) AS BIGINT) AS modified_at, o_orderpriority AS label
  FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey""",
    "doc_files": f"""SELECT *, concat(folder_path, '/', name) AS path, CASE {_KINDS} ELSE 'other' END AS media_kind FROM (
  SELECT *, CASE WHEN k = 11 THEN ['psd','png','jpg'][(file_id // 12 % 3)::INT + 1] ELSE {EXTENSIONS}[k + 1] END AS extension,
   concat(CASE WHEN k = 11 THEN concat('doc', file_id // 36) WHEN k = 2 THEN concat('doc', (file_id - 2) // 12, ' backup')
    WHEN k = 0 THEN concat('doc', file_id // 12) ELSE concat('doc', file_id) END, '.', extension) AS name FROM (
  SELECT doc_id AS file_id, (doc_id % 12)::INT AS k, concat('/corpus/', {FOLDERS}[(doc_id % 12)::INT + 1]) AS folder_path, n_chars AS size,
   {AS_OF} - (doc_id * 7919 * 13) % 94608000 AS modified_at, md5(text) AS content_hash, CASE WHEN doc_id % 17 = 0 THEN {AS_OF} END AS deleted_at FROM documents))""",
    "events_": """SELECT event_id AS id, user_id AS entity_id, event_type AS key, json_extract_string(props, '$.k') AS value,
  ['user','extractor:pdf','rule:r1','heuristic:h1','phash','ml:m1','system'][(event_id % 7)::INT + 1] AS source,
  CAST(CAST(least(value / 100, 1.0) AS FLOAT) AS DOUBLE) AS confidence, CAST(floor(epoch(ts)) AS BIGINT) AS asserted_at FROM events""",
    "live": "SELECT * FROM doc_files WHERE deleted_at IS NULL",
}
NEEDS = {"live": ["doc_files"]}


def with_tables(*names: str, recursive: bool = False) -> str:
    """A WITH clause that defines the named tables and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order)

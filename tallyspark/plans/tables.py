"""Claims and costing rows made from a star schema, with every kind of match in them.

The texts are SQL that Spark and other engines read alike; names in braces are tables.
A costing row is a part from a supplier, a claim is a part.  By the part's number claims
are coded, reworded, missized, foreign-coded, footers or unknown, and prices are typed in
several ways.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.delimited import read_delimited
from tallyspark.sources.shared import shared_dir

_PART = "p_type || ' ' || p_name || ' ' || CAST(p_size AS STRING) || 'mm'"
_CODE = "'BR-' || lpad(CAST(p_partkey AS STRING), 6, '0') || 'B' || substr(p_brand, 7)"


def _money(cents: str) -> str:
    return f"CAST(CAST(floor({cents} / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST({cents} % 100 AS STRING), 2, '0')"


def _grouped(cents: str) -> str:
    return f"CAST(CAST(floor({cents} / 100000) AS BIGINT) AS STRING) || ',' || lpad(CAST(CAST(floor({cents} / 100) AS BIGINT) % 1000 AS STRING), 3, '0') || '.' || lpad(CAST({cents} % 100 AS STRING), 2, '0')"


#: Every name of ``CLAIMS`` begins with its code.  Numbers are cut to five digits there, so from some 250,000 parts on
#: these codes repeat so often that detection would take them for words.
CLAIM_MODE = "firstToken"

COSTING = f"""
SELECT pk * 10000000 + sk AS row_num,
       CASE WHEN (pk + sk) % 11 = 0 THEN 'VND' || lpad(CAST(sk AS STRING), 4, '0') || ' ' ELSE '' END || item AS raw_name,
       CASE WHEN (pk + sk) % 9 = 1 THEN 'PHP ' || {_money("cents")}
            WHEN (pk + sk) % 9 = 2 THEN 'TBA'
            WHEN (pk + sk) % 9 = 3 THEN '0'
            WHEN (pk + sk) % 9 = 4 AND cents >= 100000 THEN '₱' || {_grouped("cents")}
            ELSE {_money("cents")} END AS raw_price,
       CASE WHEN pk % 4 = 0 THEN NULL ELSE code END AS raw_code,
       CASE WHEN (pk + sk) % 10 = 0 THEN NULL ELSE CAST(units AS DOUBLE) END AS raw_qty
FROM (
  SELECT l_partkey AS pk, l_suppkey AS sk, item, code, units, CAST(floor(ext_cents / units + 0.5) AS BIGINT) AS cents
  FROM (
    SELECT l_partkey, l_suppkey,
           CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS ext_cents,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units
    FROM {{lineitem}} GROUP BY l_partkey, l_suppkey
  ) g JOIN (SELECT p_partkey, {_PART} AS item, {_CODE} AS code FROM {{part}}) p ON g.l_partkey = p.p_partkey
  WHERE units > 0
) c
"""

CLAIMS = f"""
SELECT pk + 2 AS row_num,
       'ITM-' || lpad(CAST(pk AS STRING), 5, '0') || ' ' ||
       CASE WHEN m = 0 THEN p_name || ' ' || p_type || ' ' || CAST(p_size AS STRING) || 'mm'
            WHEN m = 1 THEN 'unlisted curio ' || CAST(pk AS STRING)
            WHEN m = 2 AND pk % 40 = 2 THEN 'GRAND TOTAL'
            WHEN m = 2 THEN 'page 12'
            WHEN m = 4 THEN item || ' ' || code
            WHEN m = 10 THEN p_type || ' ' || p_name || ' ' || CAST(p_size + 60 AS STRING) || 'mm'
            WHEN m = 11 THEN item || ' FRT LH'
            ELSE item END AS raw_name,
       CASE WHEN pk % 6 = 0 AND cents >= 100000 THEN '₱' || {_grouped("cents")}
            WHEN pk % 17 = 5 THEN 'N/A'
            WHEN pk % 17 = 6 THEN '(' || {_money("cents")} || ')'
            ELSE {_money("cents")} END AS raw_price,
       CASE WHEN m = 3 THEN other_code WHEN m BETWEEN 5 AND 9 THEN code ELSE NULL END AS raw_code,
       CASE WHEN pk % 13 = 0 THEN NULL ELSE CAST(pk % 50 + 1 AS DOUBLE) END AS raw_qty
FROM (
  SELECT p_partkey AS pk, p_partkey % 20 AS m, p_type, p_name, p_size, {_PART} AS item, {_CODE} AS code,
         CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) * (1 + p_partkey % 5) AS cents
  FROM {{part}}
) c LEFT JOIN (
  SELECT p_partkey - 7 AS other_pk, {_CODE} AS other_code FROM {{part}} WHERE p_partkey % 20 = 10
) o ON c.pk = o.other_pk
"""


def costing(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # A costing row is hardly ever more than one line, so lines are dealt out before they are summed, by what they are
    # joined on, so that they travel once.  The number is given: what follows is heavy a row, and a small table would be
    # put into one task for its few bytes.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = read("lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return spark.sql(COSTING, lineitem=lines.repartition(tasks, "l_partkey"), part=read("part"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tasks = spark.sparkContext.defaultParallelism
    # What follows is heavy a row: a table of fewer files than tasks is dealt out first.
    return spark.sql(CLAIMS, part=part.repartition(tasks) if len(part.inputFiles()) < tasks else part)


#: Claims of one file.
BOOK_ROWS = 500
# Three layouts of files: lines above the data, and the columns.
BOOKS = (
    (["Item Name,Unit Price,Part No.,Qty,Remarks"], ("raw_name", "raw_price", "raw_code", "qty", "remark")),
    (["Stock of yard seven,,,,", "", "SKU,Pcs,Descripci\u00f3n,Cost (USD),Seen"], ("raw_code", "qty", "raw_name", "raw_price", "remark")),
    (["Remarks,Fecha,Precio,Descripci\u00f3n,C\u00f3digo"], ("remark", "serial", "raw_price", "raw_name", "raw_code")),
)


def claim_files(spark: SparkSession, sf_dir: str) -> str:
    """The claims as delimited files below the shared folder, ``BOOK_ROWS`` each, in three layouts; their folder.

    Names stand in quotes, remarks hold line ends and quotes, and one layout has a column of date serials.
    """
    k = F.col("row_num") - 2
    rows = claims(spark, sf_dir).withColumn("book", F.floor(k / BOOK_ROWS).cast("int")).withColumn("kind", F.col("book") % len(BOOKS))
    rows = rows.withColumn("qty", F.col("raw_qty").cast("int").cast("string")).withColumn("serial", (46000 + k % 900).cast("string"))
    rows = rows.withColumn("remark", F.when(k % 3 == 0, F.lit('seen,\nthe "old" rack')).when(k % 3 == 1, F.lit("ok")))

    def quoted(c: str) -> Column:
        return F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))

    line = F.when(F.lit(False), "")
    heads = F.when(F.lit(False), F.array(F.lit("")))
    for i, (head, columns) in enumerate(BOOKS):
        line = line.when(F.col("kind") == i, F.concat_ws(",", *[quoted(c) for c in columns]))
        heads = heads.when(F.col("kind") == i, F.array(*[F.lit(h) for h in head]))
    body = rows.select("book", F.col("row_num").alias("at"), F.lit(0).alias("nth"), line.alias("line"))
    tops = rows.select("book", "kind").distinct().select("book", F.lit(-1).cast("long").alias("at"), F.posexplode(heads).alias("nth", "line"))
    folder = f"{shared_dir(spark)}/claim-files-{uuid.uuid4().hex}"
    ordered = body.unionByName(tops).repartition("book").sortWithinPartitions("book", "at", "nth")
    ordered.select("book", F.col("line").alias("value")).write.partitionBy("book").text(folder)
    return folder


def claim_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims' files read back as cells."""
    return read_delimited(spark, claim_files(spark, sf_dir))

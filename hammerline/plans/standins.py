"""Listing, view and probability tables made from the supplied tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "listings": """
        SELECT l.l_orderkey AS order_id, l.l_linenumber AS line, CAST(o.o_orderkey % 5 AS INT) AS fold, upper(p.p_brand) AS make, p.p_type AS model,
            CAST(year(o.o_orderdate) AS DOUBLE) AS year, l.l_extendedprice AS sold_price, l.l_quantity * 9000 AS mileage,
            CASE c.c_nationkey % 5 WHEN 0 THEN 'CAD' WHEN 1 THEN NULL ELSE 'USD' END AS currency,
            CASE o.o_orderpriority WHEN '1-URGENT' THEN 'FRONT END' WHEN '2-HIGH' THEN 'THEFT' WHEN '3-MEDIUM' THEN NULL WHEN '4-NOT SPECIFIED' THEN 'Rear  end' ELSE 'NONE' END AS primary_damage,
            CASE l.l_returnflag WHEN 'R' THEN 'SIDE' WHEN 'A' THEN 'UNDERCARRIAGE' ELSE '' END AS secondary_damage,
            CASE l.l_partkey % 4 WHEN 0 THEN 'ELECTRIC' WHEN 1 THEN 'GAS' WHEN 2 THEN ' diesel ' ELSE NULL END AS fuel_type,
            CASE l.l_suppkey % 7 WHEN 0 THEN NULL ELSE CAST(l.l_suppkey % 7 AS DOUBLE) / 2 END AS engine_volume,
            CASE l.l_suppkey % 3 WHEN 0 THEN NULL ELSE CAST(l.l_suppkey % 3 * 2 + 2 AS DOUBLE) END AS cylinders,
            CASE WHEN l.l_linenumber % 3 = 0 THEN NULL ELSE CAST(l.l_linenumber - 2 AS DOUBLE) END AS primary_damage_severity,
            CASE WHEN l.l_linenumber % 2 = 0 THEN NULL ELSE CAST(l.l_linenumber - 3 AS DOUBLE) END AS secondary_damage_severity
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "probabilities": """
        SELECT vec_id, label, embedding[0] AS a, embedding[1] AS b, embedding[2] AS c, embedding[3] AS d FROM {embeddings}""",
    "boxes": """
        SELECT event_id AS box_id, CAST(user_id AS STRING) AS vin, CAST(event_id % 4 + 1 AS INT) AS view_no, CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS channel,
            CASE event_id % 6 WHEN 0 THEN 'dent' WHEN 1 THEN 'crash' WHEN 2 THEN 'no part' WHEN 3 THEN 'lamp broken' WHEN 4 THEN 'tire flat' ELSE 'scratch' END AS class,
            CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS conf, CAST((event_id * 13) % 400 AS DOUBLE) / 4 AS x1, CAST((event_id * 29) % 300 AS DOUBLE) / 4 AS y1,
            CAST((event_id * 13) % 400 AS DOUBLE) / 4 + CAST((event_id * 7) % 160 AS DOUBLE) / 4 + 1 AS x2, CAST((event_id * 29) % 300 AS DOUBLE) / 4 + CAST((event_id * 11) % 120 AS DOUBLE) / 4 + 1 AS y2,
            200 AS img_w, 150 AS img_h
        FROM {events}""",
    "titles": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN concat('  ', o_orderpriority, '  x ')
            ELSE concat(CAST(year(o_orderdate) AS STRING), ' ', CASE o_orderkey % 5 WHEN 0 THEN 'Land Rover Range  Rover Sport Se' WHEN 1 THEN 'Bmw X 5 Premium' WHEN 2 THEN 'Toyota Camry Le' WHEN 3 THEN 'Ford F 150' ELSE 'Kia Rio' END) END AS title
        FROM {orders}""",
    "urls": """
        SELECT page_id, concat(url, CASE page_id % 4 WHEN 0 THEN '?page=7&x=1' WHEN 1 THEN '///' WHEN 2 THEN '#top' ELSE '' END) AS url, html,
            concat('https://host.example/en/car/', CAST(page_id AS STRING), '-a?x=1') AS car_url, concat('https://h.example/en/car/salwg2rv7ka', CAST(page_id % 10 AS STRING), '_x') AS vin_url
        FROM {pages}""",
}


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = set(re.findall(r"\{(\w+)\}", SQL[name]))
    return spark.sql(SQL[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(query: str, *names: str) -> str:
    """The query for DuckDB, with the named stand-ins as common tables; its lists count from 1 and its text type has another name."""
    own = {n: re.sub(r"\{(\w+)\}", r"\1", SQL[n]).replace("AS STRING", "AS VARCHAR") for n in names}
    own = {n: re.sub(r"embedding\[(\d)\]", lambda m: f"embedding[{int(m[1]) + 1}]", s) for n, s in own.items()}
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({s})" for n, s in own.items()) + " " if names else "") + query

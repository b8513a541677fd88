"""Adapters from the driver's tables to the shapes that the operators read, in Spark and in SQL.

`VIEWS[name]` is a query over the driver's tables; `{days:x}` stands for the days from 2000-01-01 to
the date x, which the two engines spell differently."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels embeddings pages conversations".split()
D = "CAST(100 AS DOUBLE)"

VIEWS = {
    "snap": f"""SELECT user_id AS trksub, ts AS stamp, event_id AS tie, CASE WHEN event_id % 11 = 0 THEN NULL ELSE least(CAST(floor(value) AS BIGINT), 100) END AS score,
      2 + event_id % 60 AS nobs, (event_id % 400) / {D} AS arc, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 97) / CAST(10 AS DOUBLE) END AS unseen, 17 + (event_id % 60) / CAST(10 AS DOUBLE) AS v,
      15 + (event_id % 130) / CAST(10 AS DOUBLE) AS h, (event_id * 7 % 2400) / {D} AS ra_h, (event_id * 13 % 17800) / {D} - 89 AS dec_deg FROM events""",
    "obs": f"""SELECT l_orderkey AS trksub, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_quantity, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS line_no,
      {{days:l_shipdate}} + l_quantity / {D} AS t, (l_partkey * 37 % 36000) / {D} AS ra, (l_suppkey * 71 % 16000) / {D} - 80 AS dec, CASE WHEN l_discount = 0 THEN NULL ELSE 17 + l_discount * 50 END AS mag,
      concat('X', l_suppkey % 12) AS obscode, CAST(l_shipdate AS DATE) AS date FROM lineitem""",
    "event": """SELECT o_custkey AS trksub, CASE o_orderkey % 9 WHEN 0 THEN 'neo' WHEN 1 THEN 'designated_other' WHEN 2 THEN 'was_not_confirmed' WHEN 3 THEN 'linked' WHEN 4 THEN 'comet'
      WHEN 5 THEN 'other' WHEN 6 THEN 'does_not_exist' WHEN 7 THEN 'was_a_star' ELSE 'neo' END AS outcome_class, CASE WHEN o_orderkey % 9 IN (0, 1, 8) THEN concat('D', o_orderkey % 50) ELSE '' END AS designation,
      CASE WHEN o_orderkey % 9 IN (0, 8) THEN concat('M', o_orderkey % 40) END AS mpec, o_orderdate AS stamp, o_orderkey AS line_no FROM orders""",
    "reported": """SELECT o_custkey AS trksub, CASE o_orderkey % 9 WHEN 0 THEN 'neo' WHEN 1 THEN 'designated_other' WHEN 2 THEN 'was_not_confirmed' WHEN 3 THEN 'linked' WHEN 4 THEN 'comet'
      WHEN 5 THEN 'other' WHEN 6 THEN 'does_not_exist' WHEN 7 THEN 'was_a_star' ELSE 'neo' END AS outcome_class, concat('R', o_orderkey % 700) AS designation, CAST(NULL AS VARCHAR(9)) AS mpec, DATE '2024-01-01' + CAST(o_orderkey % 40 AS INT) AS stamp, o_orderkey AS line_no FROM orders""",
    "scored": """SELECT d.doc_id AS id, CAST(l.quality AS BIGINT) AS y, (d.n_chars % 997) / CAST(997 AS DOUBLE) AS p, d.doc_id * 7 % 1000 AS disc, d.lang AS tag FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "d2": """SELECT p_partkey AS trksub, """ + ", ".join(f"CAST(p_partkey * {7 + 3 * i} % 101 AS INT) AS d2_{c}_raw, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey * {11 + 5 * i} % 101 AS INT) END AS d2_{c}_noid" for i, c in enumerate("Int NEO MC Hun Pho Han MB1 Pal MB2 MB3 Hil JTr JFC".split()))
    + """, CASE p_partkey % 6 WHEN 0 THEN 'G96' WHEN 1 THEN '703' WHEN 2 THEN 'F51' WHEN 3 THEN 'I41' WHEN 4 THEN 'ZZZ' END AS obscode_first FROM part""",
}
#: 8 x 8 pixels of each vector; four vectors with consecutive ids are the frames of a subject.
PIXELS = {
    "spark": "SELECT vec_id DIV 4 AS subject, CAST(vec_id % 4 AS INT) AS frame, CAST(i DIV 8 AS INT) AS r, CAST(i % 8 AS INT) AS c, CAST(x AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) e AS i, x",
    "duckdb": "SELECT vec_id // 4 AS subject, CAST(vec_id % 4 AS INT) AS frame, CAST(i // 8 AS INT) AS r, CAST(i % 8 AS INT) AS c, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)",
}


def _days(text: str, how: str) -> str:
    return re.sub(r"\{days:(\w+)\}", how, text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the driver's tables, as a DataFrame."""
    text = PIXELS["spark"] if name == "pix" else _days(VIEWS[name], r"datediff(CAST(\1 AS DATE), DATE'2000-01-01')")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", text), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(sql: str) -> str:
    """SQL for DuckDB: the views that a query names go in front of it."""
    texts = {n: _days(t, r"datediff('day', DATE '2000-01-01', CAST(\1 AS DATE))") for n, t in VIEWS.items()} | {"pix": PIXELS["duckdb"]}
    used = [n for n in texts if re.search(rf"\b(FROM|JOIN|,)\s+{n}\b", sql)]
    own = re.match(r"\s*WITH\s", sql)
    head = ", ".join(f"{n} AS ({texts[n]})" for n in used)
    if not used:
        return sql
    return f"WITH {head}, {sql[own.end():]}" if own else f"WITH {head} {sql}"

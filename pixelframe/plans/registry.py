"""Registered queries with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_LEVEL = "CAST(least(255, greatest(0, floor(128 + 400 * CAST(e.embedding[{k} + 1] AS DOUBLE)))) AS INT)"
_FRAMES = "(SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq FROM embeddings) e, range(64) t(i)"
_KEYS = "CAST(e.label AS BIGINT) AS dataset_id, e.vec_id AS image_id, e.seq, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x"

#: The views of sources.tables in DuckDB, and mask stages built on them; a view may use those before it.
VIEWS = {
    "px": f"SELECT {_KEYS}, {_LEVEL.format(k='i')} AS v FROM {_FRAMES}",
    "bgr": f"SELECT {_KEYS}, {_LEVEL.format(k='i')} AS b, {_LEVEL.format(k='(i + 1) % 64')} AS g, {_LEVEL.format(k='(i + 2) % 64')} AS r FROM {_FRAMES}",
    "acq": "SELECT o_orderkey AS dataset_id, 'proj ' || (o_custkey % 25) AS sample_project, 'proj ' || (o_custkey % 25) || '_s' || o_custkey AS sample_id, 'proj ' || (o_custkey % 25) || '_s' || o_custkey || '_' || o_orderkey AS acq_id, o_orderdate AS acq_ts, CAST(1 + o_orderkey % 7 AS BIGINT) AS acq_nb_frame, o_orderstatus = 'F' AS is_segmented, o_custkey AS customer FROM orders",
    "obj": "SELECT l_orderkey AS dataset_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, CAST(l_quantity AS BIGINT) * 20 AS area_exc, CAST(l_quantity AS BIGINT) * 20 + l_linenumber AS area, l_extendedprice / 1000 AS perim, 10 + l_quantity AS major, 5 + l_quantity / 2 AS minor FROM lineitem",
    "files": "SELECT source AS dir, 'doc_' || doc_id || '.txt' AS filename, text AS content FROM documents",
    "ledger": r"SELECT source AS dir, 'doc_' || doc_id || '.txt' AS filename, octet_length(encode(text)) AS size, sha1(encode('doc_' || doc_id || '.txt') || '\x00'::BLOB || encode(text || CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE '' END)) AS sha1 FROM documents",
    "msg": "SELECT event_id, ts, user_id AS device_id, CASE event_type WHEN 'signup' THEN 'Ready' WHEN 'click' THEN 'On' WHEN 'purchase' THEN 'Done' WHEN 'error' THEN 'Off' ELSE 'Started' END AS status, CASE WHEN event_type IN ('click','error') THEN 'status/light' ELSE 'status/pump' END AS topic, value, props AS payload FROM events",
    "paths": "SELECT page_id, url AS path FROM pages",
    "fg": "SELECT dataset_id, image_id, seq, y, x FROM px WHERE v <= 85",
    "runs": "SELECT dataset_id, image_id, seq, y, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS isle FROM fg) GROUP BY dataset_id, image_id, seq, y, isle",
    # components of each image by spreading the smallest reachable pixel; labels in raster order
    "edges": "SELECT a.image_id, a.y * 8 + a.x AS p, b.y * 8 + b.x AS q FROM fg a JOIN fg b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1",
    "reach": "SELECT image_id, y * 8 + x AS p, y * 8 + x AS q FROM fg UNION SELECT r.image_id, r.p, e.q FROM reach r JOIN edges e ON r.image_id = e.image_id AND r.q = e.p WHERE e.q > 0 OR e.q = 0",
    "roots": "SELECT image_id, p, min(q) AS root FROM reach GROUP BY image_id, p",
    "regions": "SELECT image_id, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM roots",
}
NEEDS = {"fg": ("px",), "runs": ("px", "fg"), "edges": ("px", "fg"), "reach": ("px", "fg", "edges"), "roots": ("px", "fg", "edges", "reach"), "regions": ("px", "fg", "edges", "reach", "roots")}


def with_views(sql: str, views: tuple[str, ...] = ()) -> str:
    """The SQL with the views it names in front."""
    wanted = {w for v in views for w in (*NEEDS.get(v, ()), v)}
    parts = [f"{name} AS {'' if name == 'reach' else 'MATERIALIZED '}({text})" for name, text in VIEWS.items() if name in wanted]
    if not parts:
        return sql
    if sql.lstrip().upper().startswith("WITH "):
        sql = sql.lstrip()[5:]
        return f"WITH RECURSIVE {', '.join(parts)}, {sql}"
    return f"WITH RECURSIVE {', '.join(parts)} {sql}"


def query(key: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under a key; sql over the views named gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[key] = f
        if sql:
            SQL[key] = with_views(sql, views)
        return f

    return add

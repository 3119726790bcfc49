"""Queries of the text operators over the whole test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgrid.llm import mixing, sentences, survivors, tokens
from siltgrid.operators.near import EARTH
from siltgrid.session import latest, table


def _taken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current versions of the points and of their scores."""
    columns = ["stack_id", "patch_id", "az", "rg", "lon", "lat", "d_a", "hgt", "inc", "la", "processed_at"]
    points = latest(table(spark, sf_dir, "ps2").where("ps_id is not null"), ["ps_id"], columns)
    return points, latest(table(spark, sf_dir, "select1").where("ps_id is not null"), ["ps_id"], ["coh_ps2"])


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record to keep and fused fields of every pixel that was taken more than once."""
    fields = {"az": 1.0, "rg": 1.0, "d_a": 0.01, "hgt": 1.0, "inc": 0.01, "la": 0.01}
    return survivors.survivors(*_taken(spark, sf_dir), "ps_id", "stack_id", "patch_id", fields, ["d_a", "hgt", "inc", "la"], "coh_ps2", "processed_at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record to keep of every pixel that was taken more than once: p6_survivors' without the fusion, which has no part in it."""
    best = survivors.best_records(*_taken(spark, sf_dir), "ps_id", "stack_id", ["d_a", "hgt", "inc", "la"], "coh_ps2", "processed_at")
    return best.select("group_id", "best_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents, how often each is used, and the target and actual share of its source."""
    chosen, shares = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return chosen.join(F.broadcast(shares.select("source", "target_share", "actual_share")), "source")  # a row per target source


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget, chosen counts and actual share of each source."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the last character of each sentence of every document."""
    return sentences.sentence_ends(table(spark, sf_dir, "documents")).select("doc_id", "end_pos")


#: Pairs by brute force within a stack, groups by reachability, the record to keep by the stated order.
P6_FOUND = f"""
WITH RECURSIVE p AS (SELECT ps_id, r.* FROM (SELECT ps_id, arg_max(struct_pack(stack_id := stack_id, lon := lon, lat := lat, d_a := d_a, hgt := hgt, inc := inc, la := la, taken := processed_at), coalesce(loaded_at, TIMESTAMP '0001-01-01')) AS r
    FROM ps2 WHERE ps_id IS NOT NULL GROUP BY ps_id) WHERE isfinite(r.lon) AND isfinite(r.lat) AND abs(r.lat) <= 90 AND NOT (r.lon = 0 AND r.lat = 0)),
sc AS (SELECT ps_id, arg_max(struct_pack(c := coh_ps2), coalesce(loaded_at, TIMESTAMP '0001-01-01')) AS r FROM select1 WHERE ps_id IS NOT NULL GROUP BY ps_id),
e AS (SELECT ps_id, stack_id, {EARTH} * cos(radians(lat)) * cos(radians(lon)) AS x, {EARTH} * cos(radians(lat)) * sin(radians(lon)) AS y, {EARTH} * sin(radians(lat)) AS z FROM p),
link AS (SELECT a.ps_id AS a, b.ps_id AS b FROM e a JOIN e b ON a.stack_id = b.stack_id AND a.ps_id <> b.ps_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 2.25),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
grouped AS (SELECT a AS ps_id, least(a, min(b)) AS group_id FROM reach GROUP BY a),
scored AS (SELECT group_id, p.ps_id, CASE WHEN sc.r.c BETWEEN 0 AND 1 AND NOT isnan(sc.r.c) THEN sc.r.c ELSE -1 END AS trust, taken,
    {' + '.join(f'CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN 1 ELSE 0 END' for c in ('d_a', 'hgt', 'inc', 'la'))} AS filled
  FROM grouped JOIN p USING (ps_id) LEFT JOIN sc USING (ps_id))
SELECT group_id, ps_id AS best_id FROM scored QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY trust DESC, filled DESC, coalesce(taken, TIMESTAMP '0001-01-01') DESC, ps_id) = 1
"""


def queries() -> dict:
    return {f.__name__: f for f in (p6_found, p6_survivors, p8_ids, p9_mix, p9_shares, p10_found)}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_FOUND}

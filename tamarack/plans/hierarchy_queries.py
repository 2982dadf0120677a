"""Queries over the forest of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.hierarchy import closure, resolve_hierarchy
from tamarack.sources.tables import table


def _categories(spark: SparkSession, sf_dir: str, paths: bool, **bounds: int) -> DataFrame:
    return resolve_hierarchy(table(spark, sf_dir, "categories"), "category_id", "parent_category_id", "category_name", "created_at", paths=paths, **bounds)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(spark, sf_dir, False).where("place <> 'in_tree'").select(F.col("id").alias("category_id"), "place")


def p1_paths(spark: SparkSession, sf_dir: str, **bounds: int) -> DataFrame:
    names = F.concat_ws(" > ", F.reverse(F.transform("path", lambda s: s["name"])))
    return _categories(spark, sf_dir, True, **bounds).select(F.col("id").alias("category_id"), F.col("root").alias("root_id"), "depth", "place", F.when(F.col("place") == "in_tree", names).alias("path"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(_categories(spark, sf_dir, True)).select(F.col("ancestor").alias("category_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("long").alias("distance"))


def k01_hierarchy_in_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p1_paths`` over fragments so small that even small tables are contracted over several levels, with hot exits sent in copies."""
    return p1_paths(spark, sf_dir, fragment_rows=60, hot_rows=3)


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "k01_hierarchy_in_fragments": k01_hierarchy_in_fragments}

_VALID = """valid AS (
  SELECT category_id AS id, arg_max(parent_category_id, created_at) AS parent_any, max(created_at) AS at FROM categories GROUP BY 1),
node AS (
  SELECT DISTINCT c.category_id AS id, c.parent_category_id AS parent, c.category_name AS name
  FROM categories c JOIN valid v ON c.category_id = v.id AND c.created_at = v.at)"""
_UP = """up AS (
  SELECT id, parent, [id] AS seen, FALSE AS looped FROM node
  UNION ALL
  SELECT u.id, n.parent, list_append(u.seen, n.id), list_contains(u.seen, n.id)
  FROM up u JOIN node n ON u.parent = n.id WHERE NOT u.looped)"""
ORACLE = {
    "p1_found": f"""WITH RECURSIVE {_VALID}, {_UP}
SELECT id AS category_id, CASE WHEN seen[-1] = id THEN 'on_loop' ELSE 'below_loop' END AS place FROM up WHERE looped""",
    "p1_paths": f"""WITH RECURSIVE {_VALID}, {_UP},
down AS (
  SELECT n.id, n.id AS root_id, CAST(0 AS BIGINT) AS depth, n.name AS path
  FROM node n LEFT JOIN node p ON n.parent = p.id WHERE p.id IS NULL
  UNION ALL
  SELECT n.id, d.root_id, d.depth + 1, d.path || ' > ' || n.name FROM down d JOIN node n ON n.parent = d.id)
SELECT id AS category_id, root_id, depth, 'in_tree' AS place, path FROM down
UNION ALL
SELECT id, NULL, NULL, CASE WHEN seen[-1] = id THEN 'on_loop' ELSE 'below_loop' END, NULL FROM up WHERE looped""",
    "p1_descendants": f"""WITH RECURSIVE {_VALID},
down AS (
  SELECT n.id, [n.id] AS path FROM node n LEFT JOIN node p ON n.parent = p.id WHERE p.id IS NULL
  UNION ALL
  SELECT n.id, list_append(d.path, n.id) FROM down d JOIN node n ON n.parent = d.id)
SELECT path[i] AS category_id, id AS descendant_id, CAST(len(path) - i AS BIGINT) AS distance
FROM (SELECT id, path, unnest(range(1, len(path))) AS i FROM down)""",
}
ORACLE["k01_hierarchy_in_fragments"] = ORACLE["p1_paths"]

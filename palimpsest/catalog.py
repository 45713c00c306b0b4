"""Queries over the store's tables, with equivalent SQL where SQL can express them."""

from palimpsest.operators import hierarchy, orphans, snapshots
from palimpsest.sources.tables import table


def _orphans(spark, d):
    return orphans.orphan_references(*(table(spark, d, t) for t in ("revision", "dirstate_header", "index_node", "removed_key")))


def _tree(spark, d):
    return table(spark, d, "entry"), table(spark, d, "inventory")


QUERIES = {
    "p3_found": _orphans,
    "p3_report": lambda s, d: orphans.orphan_report(_orphans(s, d)),
    "p4_found": lambda s, d: hierarchy.hierarchy(*_tree(s, d), full=False),
    "p4_tree": lambda s, d: hierarchy.hierarchy(*_tree(s, d)),
    "descendants": lambda s, d: hierarchy.descendants(*_tree(s, d)),
    "ancestor_ids": lambda s, d: hierarchy.ancestor_ids(*_tree(s, d)),
    "p5_found": lambda s, d: snapshots.snapshot_changes(*_tree(s, d)),
    "p5_values": lambda s, d: snapshots.changed_values(*_tree(s, d)),
}

_P3 = """
WITH rm AS (SELECT DISTINCT tab, rec_key FROM removed_key),
node AS (SELECT index_name || ':' || array_to_string(key, '/') AS k, coalesce(absent, false) AS absent, index_name, refs, arrived_at FROM index_node),
rev AS (SELECT revision_id AS k, min(arrived_at) AS here FROM revision GROUP BY 1),
here AS (SELECT k, min(arrived_at) AS here FROM node WHERE NOT absent GROUP BY 1),
gap AS (SELECT k, min(arrived_at) AS here FROM node WHERE absent GROUP BY 1),
head AS (SELECT header_id AS k, min(arrived_at) AS here FROM dirstate_header GROUP BY 1),
pairs AS (
  SELECT DISTINCT 'revision' AS tab, 'parent_ids' AS field, k AS rec_key, here AS first, r AS ref_key, 'revision' AS target
  FROM (SELECT revision_id AS k, unnest(parent_ids) AS r FROM revision) JOIN rev USING (k) WHERE r IS NOT NULL AND r <> 'null:'
  UNION ALL
  SELECT DISTINCT 'dirstate_header', 'ghosts', k, here, r, 'revision'
  FROM (SELECT header_id AS k, unnest(ghosts) AS r FROM dirstate_header) JOIN head USING (k) WHERE r IS NOT NULL AND r <> 'null:'
  UNION ALL
  SELECT DISTINCT 'index_node', 'refs', k, here, index_name || ':' || array_to_string(r, '/'), 'index_node'
  FROM (SELECT k, index_name, unnest(flatten(refs)) AS r FROM node WHERE NOT absent) JOIN here USING (k)
  WHERE r IS NOT NULL AND len(r) > 0 AND len(list_filter(r, lambda x: x IS NULL)) = 0 AND r <> ['null:']
  UNION ALL
  SELECT 'index_node', 'absent', k, here, k, 'index_node' FROM gap),
target AS (SELECT 'revision' AS target, k AS ref_key, here FROM rev UNION ALL SELECT 'index_node', k, here FROM here),
found AS (
  SELECT p.tab, p.field, strftime(p.first, '%Y-%m') AS period, p.rec_key, p.ref_key,
    CASE WHEN rm.rec_key IS NOT NULL THEN 'deleted' WHEN t.here IS NULL THEN 'missing' WHEN t.here > p.first THEN 'late' END AS state
  FROM pairs p LEFT JOIN rm ON rm.tab = p.target AND rm.rec_key = p.ref_key LEFT JOIN target t USING (target, ref_key))
"""

_CONTENT = ", ".join(snapshots.CONTENT)
_P5 = f"""
WITH inv AS (SELECT branch, seq, min(snapshot) AS snapshot FROM inventory GROUP BY ALL),
step AS (SELECT lag(snapshot) OVER (PARTITION BY branch ORDER BY seq) AS older, snapshot AS newer FROM inv),
e AS (SELECT DISTINCT snapshot, file_id, {_CONTENT} FROM entry),
a AS (SELECT s.newer, e.* FROM e JOIN step s ON e.snapshot = s.newer WHERE s.older IS NOT NULL),
b AS (SELECT s.newer, e.* FROM e JOIN step s ON e.snapshot = s.older),
found AS (SELECT coalesce(a.newer, b.newer) AS snapshot, coalesce(a.file_id, b.file_id) AS file_id,
    CASE WHEN b.file_id IS NULL THEN 'added' WHEN a.file_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
    {", ".join(f"CASE WHEN a.file_id IS NULL THEN b.{c} ELSE a.{c} END AS {c}" for c in snapshots.CONTENT)}
  FROM a FULL JOIN b ON a.newer = b.newer AND a.file_id = b.file_id
  WHERE a.file_id IS NULL OR b.file_id IS NULL OR {" OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in snapshots.CONTENT)})
"""

_P4 = """
WITH RECURSIVE inv AS (SELECT DISTINCT snapshot, root_id FROM inventory),
e AS (SELECT DISTINCT snapshot, file_id, parent_id FROM entry),
up AS (SELECT e.snapshot, e.file_id, e.parent_id, i.root_id IS NOT NULL AND e.file_id = i.root_id AS is_root, i.root_id IS NOT NULL AND e.parent_id = i.root_id AS below_root,
    e.parent_id IS NULL OR q.file_id IS NULL AS is_end
  FROM e LEFT JOIN inv i USING (snapshot) LEFT JOIN e q ON q.snapshot = e.snapshot AND q.file_id = e.parent_id),
good AS (SELECT snapshot, file_id FROM up WHERE is_root OR below_root UNION
  SELECT u.snapshot, u.file_id FROM up u JOIN good g ON u.snapshot = g.snapshot AND u.parent_id = g.file_id),
bad AS (SELECT * FROM up WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.snapshot = up.snapshot AND g.file_id = up.file_id)),
loose AS (SELECT snapshot, file_id FROM bad WHERE is_end UNION
  SELECT b.snapshot, b.file_id FROM bad b JOIN loose l ON b.snapshot = l.snapshot AND b.parent_id = l.file_id),
ring AS (SELECT * FROM bad WHERE NOT EXISTS (SELECT 1 FROM loose l WHERE l.snapshot = bad.snapshot AND l.file_id = bad.file_id)),
walk AS (SELECT snapshot, file_id, parent_id AS cur FROM ring UNION
  SELECT w.snapshot, w.file_id, r.parent_id FROM walk w JOIN ring r ON r.snapshot = w.snapshot AND r.file_id = w.cur),
cyc AS (SELECT DISTINCT snapshot, file_id FROM walk WHERE cur = file_id)
SELECT snapshot, file_id, 'detached' AS state FROM loose
UNION ALL SELECT r.snapshot, r.file_id, CASE WHEN c.file_id IS NULL THEN 'below_cycle' ELSE 'on_cycle' END FROM ring r LEFT JOIN cyc c USING (snapshot, file_id)
"""

_STATES = _P4.split("SELECT snapshot, file_id, 'detached'")[0] + """, st AS (SELECT snapshot, file_id, 'detached' AS state FROM loose
  UNION ALL SELECT r.snapshot, r.file_id, CASE WHEN c.file_id IS NULL THEN 'below_cycle' ELSE 'on_cycle' END FROM ring r LEFT JOIN cyc c USING (snapshot, file_id) UNION ALL SELECT snapshot, file_id, 'ok' FROM good),
n AS (SELECT DISTINCT snapshot, file_id, parent_id, coalesce(name, '') AS name FROM entry),
k AS (SELECT n.*, st.state, up.is_root, st.state = 'detached' AND up.is_end AS is_loose_end FROM n JOIN up USING (snapshot, file_id) JOIN st USING (snapshot, file_id)),
p AS (SELECT snapshot, root_id AS file_id, root_id AS root, '' AS path, 0 AS depth, [root_id] AS way FROM inv UNION SELECT snapshot, file_id, file_id, name, 0, [file_id] FROM k WHERE is_loose_end
  UNION SELECT k.snapshot, k.file_id, p.root, p.path || '/' || k.name, p.depth + 1, list_append(p.way, k.file_id) FROM k JOIN p ON p.snapshot = k.snapshot AND p.file_id = k.parent_id WHERE NOT k.is_root AND NOT k.is_loose_end),
above AS (SELECT snapshot, file_id AS node, parent_id AS anc FROM k WHERE NOT is_root AND NOT is_loose_end UNION SELECT a.snapshot, a.node, k.parent_id FROM above a JOIN k ON k.snapshot = a.snapshot AND k.file_id = a.anc WHERE NOT k.is_root AND NOT k.is_loose_end),
places AS (SELECT snapshot, file_id, row_number() OVER (PARTITION BY snapshot, root ORDER BY way) - 1 AS first_place FROM p),
below AS (SELECT snapshot, anc AS file_id, count(*) AS n FROM above GROUP BY ALL)
"""

ORACLE: dict[str, str] = {
    "p4_tree": _STATES + """SELECT k.snapshot, k.file_id, k.state, p.root, CAST(p.depth AS BIGINT) AS depth, CASE WHEN p.path = '' THEN '/' ELSE p.path END AS path, CASE WHEN k.state <> 'on_cycle' THEN coalesce(below.n, 0) END AS n_descendants, w.first_place
FROM k LEFT JOIN places w USING (snapshot, file_id) LEFT JOIN p USING (snapshot, file_id) LEFT JOIN below USING (snapshot, file_id)""",
    "descendants": _STATES + "SELECT a.snapshot, a.anc AS file_id, a.node AS descendant FROM above a JOIN k n ON n.snapshot = a.snapshot AND n.file_id = a.node JOIN k u ON u.snapshot = a.snapshot AND u.file_id = a.anc WHERE n.state IN ('ok', 'detached')",
    "ancestor_ids": _STATES + """, far AS (SELECT a.snapshot, a.node, a.anc, coalesce(p.depth, 0) AS depth FROM above a LEFT JOIN p ON p.snapshot = a.snapshot AND p.file_id = a.anc)
SELECT k.snapshot, k.file_id, coalesce(list(far.anc ORDER BY far.depth DESC) FILTER (WHERE far.anc IS NOT NULL), []) AS ancestors FROM k LEFT JOIN far ON far.snapshot = k.snapshot AND far.node = k.file_id WHERE k.state IN ('ok', 'detached') GROUP BY ALL""",
    "p3_found": _P3 + "SELECT DISTINCT * FROM found WHERE state IS NOT NULL",
    "p3_report": _P3 + "SELECT tab, field, period, state, count(*) AS n_refs, count(DISTINCT ref_key) AS n_targets FROM (SELECT DISTINCT * FROM found WHERE state IS NOT NULL) GROUP BY ALL",
    "p4_found": _P4,
    "p5_found": _P5 + "SELECT snapshot, file_id, change FROM found",
    "p5_values": _P5 + "SELECT * FROM found",
}

from palimpsest import catalog_formats, catalog_store, catalog_versions  # noqa: E402

QUERIES |= catalog_store.QUERIES | catalog_versions.QUERIES | catalog_formats.QUERIES
ORACLE |= catalog_store.ORACLE | catalog_versions.ORACLE | catalog_formats.ORACLE

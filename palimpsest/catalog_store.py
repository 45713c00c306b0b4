"""Queries of the store's own operators over whole tables, each with the SQL it must equal."""

from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.operators import contentmap, graph, index, packs, storage, text, tree
from palimpsest.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def nodes(s, d):
    return table(s, d, "index_node")


def flat(df):
    return df.withColumn("key", F.array_join("key", "/"))


def tree_tables(s, d):
    return table(s, d, "entry"), table(s, d, "inventory")


# ---- indices ----

_COMBINED = """combined AS (SELECT index_name, key, src, value, refs FROM (SELECT *, row_number() OVER (PARTITION BY index_name, key
  ORDER BY src NULLS FIRST, arrived_at NULLS FIRST, value NULLS FIRST, refs NULLS FIRST) AS rn FROM index_node WHERE NOT coalesce(absent, false) AND key IS NOT NULL) WHERE rn = 1)"""


@query("combined_index", f"WITH {_COMBINED} SELECT index_name, array_to_string(key, '/') AS key, src, value, len(flatten(refs)) AS n_refs FROM combined")
def _(s, d):
    return flat(index.combined(nodes(s, d)).withColumn("n_refs", F.size(F.flatten("refs")).cast("bigint")).drop("refs"))


@query("point_lookup", f"WITH {_COMBINED} SELECT index_name, array_to_string(key, '/') AS key, value FROM combined WHERE index_name = 'revisions' AND key[1] IN (SELECT revision_id FROM revision)")
def _(s, d):
    keys = table(s, d, "revision").select(F.lit("revisions").alias("index_name"), F.array("revision_id").alias("key"))
    return flat(index.point_lookup(nodes(s, d), keys).select("index_name", "key", "value"))


@query("missing_keys", "SELECT DISTINCT 'revisions' AS index_name, revision_id AS key FROM revision WHERE revision_id NOT IN (SELECT key[1] FROM index_node WHERE index_name = 'revisions' AND NOT coalesce(absent, false))")
def _(s, d):
    keys = table(s, d, "revision").select(F.lit("revisions").alias("index_name"), F.array("revision_id").alias("key"))
    return flat(index.missing_keys(nodes(s, d), keys))


@query("prefix_lookup", f"""WITH {_COMBINED}, gap AS (SELECT DISTINCT index_name, key FROM index_node WHERE absent)
SELECT index_name, array_to_string(key, '/') AS key, value FROM combined c WHERE EXISTS (SELECT 1 FROM gap g WHERE g.index_name = c.index_name AND g.key[1] = c.key[1] AND (len(g.key) = 2 OR g.key = c.key))""")
def _(s, d):
    """All rows that share their first element with a placeholder's key: prefixes of one element, beside whole keys."""
    gaps = nodes(s, d).where("absent")
    wanted = gaps.select("index_name", F.slice("key", 1, 1).alias("prefix")).unionAll(gaps.select("index_name", F.col("key").alias("prefix")))
    return flat(index.prefix_lookup(nodes(s, d), wanted).select("index_name", "key", "value"))


@query("key_count", "SELECT index_name, src, count(DISTINCT key) AS n_keys FROM index_node WHERE NOT coalesce(absent, false) GROUP BY ALL")
def _(s, d):
    return index.key_count(nodes(s, d))


@query("row_problems", """
WITH t AS (SELECT *, CASE WHEN index_name = 'texts' THEN 2 ELSE 1 END AS arity, CASE WHEN index_name = 'texts' THEN 2 WHEN index_name = 'revisions' THEN 1 ELSE 0 END AS lists FROM (SELECT index_name, src, key, absent, value, refs FROM index_node UNION ALL SELECT 'signatures', src, key, absent, value || chr(10), refs FROM index_node WHERE index_name = 'revisions' UNION ALL SELECT 'texts', src, key, absent, value, refs FROM index_node WHERE index_name = 'revisions')),
u AS (SELECT index_name, src, array_to_string(key, '/') AS key, CASE
  WHEN NOT coalesce(len(key) = arity AND len(list_filter(key, lambda x: x IS NULL OR x = '' OR regexp_matches(x, '[ \\t\\n\\x0B\\f\\r\\x00]'))) = 0, false) THEN 'bad key'
  WHEN absent THEN NULL WHEN NOT coalesce(NOT regexp_matches(value, '[\\n\\x00]'), false) THEN 'bad value' WHEN len(refs) <> lists THEN 'wrong number of reference lists'
  WHEN len(list_filter(flatten(refs), lambda k: NOT coalesce(len(k) = arity AND len(list_filter(k, lambda x: x IS NULL OR x = '' OR regexp_matches(x, '[ \\t\\n\\x0B\\f\\r\\x00]'))) = 0, false))) > 0 THEN 'bad reference' END AS reason FROM t)
SELECT * FROM u WHERE reason IS NOT NULL""")
def _(s, d):
    """All rows, beside rows of revisions that claim to be texts or signatures, the latter with a line feed in their values."""
    cols = ["index_name", "src", "key", "absent", "value", "refs"]
    every = nodes(s, d).select(*cols)
    revs = every.where("index_name = 'revisions'")
    wrong = revs.withColumn("index_name", F.lit("signatures")).withColumn("value", F.concat("value", F.lit("\n"))).unionByName(revs.withColumn("index_name", F.lit("texts")))
    return index.row_problems(every.unionByName(wrong))


@query("parent_map", f"WITH {_COMBINED} SELECT index_name, array_to_string(key, '/') AS key, CASE WHEN len(refs) > 0 AND len(refs[1]) > 0 THEN array_to_string(list_transform(refs[1], lambda k: array_to_string(k, '/')), ' ') ELSE 'null:' END AS parents FROM combined")
def _(s, d):
    return flat(index.parent_map(nodes(s, d))).withColumn("parents", F.array_join(F.transform("parents", lambda k: F.array_join(k, "/")), " "))


@query("external_references", f"""WITH {_COMBINED}, e AS (SELECT DISTINCT index_name, unnest(refs[1]) AS key FROM combined WHERE len(refs) > 0)
SELECT index_name, array_to_string(key, '/') AS key FROM e WHERE NOT EXISTS (SELECT 1 FROM combined c WHERE c.index_name = e.index_name AND c.key = e.key)""")
def _(s, d):
    return flat(index.external_references(nodes(s, d), 0))


@query("missing_compression_parents", """WITH here AS (SELECT DISTINCT src, index_name, key FROM index_node WHERE NOT coalesce(absent, false)),
e AS (SELECT DISTINCT src, index_name, unnest(refs[2]) AS key FROM index_node WHERE NOT coalesce(absent, false) AND len(refs) > 1)
SELECT e.src, e.index_name, array_to_string(e.key, '/') AS key FROM e WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.src = e.src AND h.index_name = e.index_name AND h.key = e.key)""")
def _(s, d):
    """What each source's texts build on that the source itself lacks."""
    return flat(index.missing_bases(nodes(s, d)))


@query("referrers", f"""WITH {_COMBINED}, e AS (SELECT index_name, key AS child, unnest(refs[1]) AS key FROM combined WHERE len(refs) > 0)
SELECT index_name, array_to_string(key, '/') AS key, count(DISTINCT child) AS n_referrers, coalesce(bool_or(EXISTS (SELECT 1 FROM combined c WHERE c.index_name = e.index_name AND c.key = e.key)), false) AS here FROM e GROUP BY e.index_name, e.key""")
def _(s, d):
    return flat(index.referrers(nodes(s, d)))


@query("with_placeholders", f"""WITH {_COMBINED}, e AS (SELECT index_name, unnest(flatten(refs[1:2])) AS key FROM combined)
SELECT index_name, array_to_string(key, '/') AS key, false AS absent, value FROM combined UNION ALL
SELECT DISTINCT index_name, array_to_string(key, '/'), true, NULL FROM e WHERE NOT EXISTS (SELECT 1 FROM combined c WHERE c.index_name = e.index_name AND c.key = e.key)""")
def _(s, d):
    return flat(index.with_placeholders(nodes(s, d)))


@query("source_conflicts", """SELECT index_name, array_to_string(key, '/') AS key, count(DISTINCT src) AS n_sources, count(DISTINCT coalesce(value, chr(0))) AS n_values, count(DISTINCT refs) AS n_refs
FROM index_node WHERE NOT coalesce(absent, false) GROUP BY index_name, key HAVING count(DISTINCT coalesce(value, chr(0))) > 1 OR count(DISTINCT refs) > 1""")
def _(s, d):
    return flat(index.source_conflicts(nodes(s, d)))


# ---- packs: each source of an index is one ----


@query("build_details", f"""WITH {_COMBINED} SELECT index_name, array_to_string(key, '/') AS key, src, CASE WHEN refs[2][1] IS NULL THEN 'fulltext' ELSE 'line-delta' END AS method, array_to_string(refs[2][1], '/') AS basis,
CAST(split_part(value, ' ', 1) AS BIGINT) AS start, CAST(split_part(value, ' ', 2) AS BIGINT) AS length FROM combined""")
def _(s, d):
    return flat(packs.build_details(nodes(s, d)).withColumn("basis", F.array_join("basis", "/")).drop("parents"))


@query("read_ranges", f"""WITH {_COMBINED}, p AS (SELECT DISTINCT src, CAST(split_part(value, ' ', 1) AS BIGINT) AS start, CAST(split_part(value, ' ', 1) AS BIGINT) + CAST(split_part(value, ' ', 2) AS BIGINT) AS "end" FROM combined),
c AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY src ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 64 THEN 1 ELSE 0 END AS fresh FROM p),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY start, "end") AS k FROM c) SELECT src, min(start) AS start, max("end") AS "end", count(*) AS n FROM g GROUP BY src, k""")
def _(s, d):
    return packs.read_ranges(packs.build_details(nodes(s, d)), 64)


@query("pack_problems", """WITH r AS (SELECT DISTINCT src, index_name, key FROM index_node WHERE NOT coalesce(absent, false)), b AS (SELECT src, index_name, key, min(refs[2][1]) AS basis FROM index_node WHERE NOT coalesce(absent, false) GROUP BY ALL)
SELECT src, index_name, array_to_string(key, '/') AS key, index_name || ' of a revision that is not here' AS problem FROM r WHERE index_name <> 'revisions' AND NOT EXISTS (SELECT 1 FROM r v WHERE v.src = r.src AND v.index_name = 'revisions' AND v.key[1] = r.key[-1])
UNION ALL SELECT src, index_name, array_to_string(key, '/'), 'basis is not here' FROM b WHERE basis IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r v WHERE v.src = b.src AND v.index_name = b.index_name AND v.key = b.basis)""")
def _(s, d):
    return flat(packs.pack_problems(nodes(s, d)))


@query("packs", "SELECT doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents")
def _(s, d):
    """All documents laid into containers, indexed by one walk, and read back by their places."""
    from palimpsest.plans.durable import durable

    made = durable(packs.packed(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.encode("text", "utf-8").alias("body")), 500))
    return packs.read_packed(made, packs.pack_index(made)).select(F.col("key").cast("bigint").alias("doc_id"), F.sha1("body").alias("sha1"))


# ---- graphs: the revisions and their parents, ghosts included ----

_DAG = "dag AS (SELECT DISTINCT revision_id AS child, unnest(parent_ids) AS parent FROM revision), g AS (SELECT child, parent FROM dag WHERE parent IS NOT NULL AND parent <> 'null:' AND child IS NOT NULL)"
_HEADS = "tips AS (SELECT DISTINCT revision_id AS tip FROM revision WHERE revision_id IS NOT NULL AND revision_id NOT IN (SELECT parent FROM g))"


def dag(s, d):
    r = table(s, d, "revision")
    return r.select(F.col("revision_id").alias("child"), F.posexplode("parent_ids").alias("ord", "parent")).where("child IS NOT NULL AND parent IS NOT NULL AND parent <> 'null:'")


def revision_nodes(s, d):
    return table(s, d, "revision").where("revision_id IS NOT NULL").select(F.col("revision_id").alias("node"))


@query("ancestry", f"WITH RECURSIVE {_DAG}, {_HEADS}, a AS (SELECT tip, tip AS node FROM tips UNION SELECT a.tip, g.parent FROM a JOIN g ON g.child = a.node) SELECT * FROM a")
def _(s, d):
    """Ancestries of all heads, as pairs."""
    return graph.ancestors(dag(s, d), graph.heads(dag(s, d), revision_nodes(s, d)).withColumnRenamed("node", "tip"))


@query("ancestor_counts", f"WITH RECURSIVE {_DAG}, a AS (SELECT DISTINCT revision_id AS tip, revision_id AS node FROM revision WHERE revision_id IS NOT NULL UNION SELECT a.tip, g.parent FROM a JOIN g ON g.child = a.node) SELECT tip AS node, count(*) AS n_ancestors FROM a GROUP BY 1")
def _(s, d):
    """The size of every revision's ancestry."""
    return graph.ancestor_counts(dag(s, d), revision_nodes(s, d)).withColumn("n_ancestors", F.col("n_ancestors").cast("bigint"))


@query("topo_levels", f"""WITH RECURSIVE {_DAG}, e AS (SELECT * FROM g WHERE parent IN (SELECT revision_id FROM revision)),
l AS (SELECT DISTINCT revision_id AS node, 0 AS level FROM revision WHERE revision_id IS NOT NULL AND revision_id NOT IN (SELECT child FROM e) UNION SELECT e.child, l.level + 1 FROM l JOIN e ON e.parent = l.node)
SELECT node, max(level) AS level FROM l GROUP BY 1""")
def _(s, d):
    return graph.topological(dag(s, d), revision_nodes(s, d))


@query("revision_heads", "SELECT DISTINCT revision_id AS node FROM revision WHERE revision_id NOT IN (SELECT r FROM (SELECT unnest(parent_ids) AS r FROM revision) WHERE r IS NOT NULL)")
def _(s, d):
    r = table(s, d, "revision")
    e = r.select(F.col("revision_id").alias("child"), F.explode("parent_ids").alias("parent")).where("parent IS NOT NULL")
    return graph.heads(e, r.select(F.col("revision_id").alias("node")))


@query("revision_ghosts", "SELECT r AS node, count(DISTINCT revision_id) AS n_children FROM (SELECT revision_id, unnest(parent_ids) AS r FROM revision) WHERE r IS NOT NULL AND r <> 'null:' AND r NOT IN (SELECT revision_id FROM revision) GROUP BY 1")
def _(s, d):
    r = table(s, d, "revision")
    e = r.select("revision_id", F.explode("parent_ids").alias("node")).where("node IS NOT NULL AND node <> 'null:'")
    return e.join(r.select(F.col("revision_id").alias("node")), "node", "left_anti").groupBy("node").agg(F.count_distinct("revision_id").alias("n_children"))


@query("common_ancestors", f"""WITH RECURSIVE {_DAG}, pairs AS (SELECT DISTINCT x.parent AS a, y.parent AS b FROM g x JOIN g y ON x.child = y.child AND x.parent < y.parent),
up AS (SELECT a AS tip, a AS node FROM pairs UNION SELECT b, b FROM pairs UNION SELECT up.tip, g.parent FROM up JOIN g ON g.child = up.node),
both_ AS (SELECT p.a, p.b, x.node FROM pairs p JOIN up x ON x.tip = p.a JOIN up y ON y.tip = p.b AND y.node = x.node),
below AS (SELECT DISTINCT o.a, o.b, g.parent AS node FROM both_ o JOIN g ON g.child = o.node)
SELECT a, b, node AS lca FROM both_ EXCEPT SELECT a, b, node FROM below""")
def _(s, d):
    """The merge bases of every two parents of a merge."""
    e = graph.clean_edges(dag(s, d))
    pairs = e.withColumnRenamed("parent", "a").join(e.withColumnRenamed("parent", "b"), "child").where("a < b").select("a", "b")
    return graph.common_ancestors(e, pairs)


@query("delta_chains", f"""WITH RECURSIVE {_COMBINED}, l AS (SELECT array_to_string(key, '/') AS key, array_to_string(refs[2][1], '/') AS parent, CAST(split_part(value, ' ', 2) AS DOUBLE) AS size FROM combined WHERE index_name = 'texts'),
c AS (SELECT key, key AS root, 0 AS depth, size AS total FROM l WHERE parent IS NULL OR parent NOT IN (SELECT key FROM l)
  UNION ALL SELECT l.key, c.root, c.depth + 1, c.total + l.size FROM l JOIN c ON l.parent = c.key)
SELECT l.key, c.root, c.depth, c.total FROM l LEFT JOIN c USING (key)""")
def _(s, d):
    t = index.combined(nodes(s, d)).where("index_name = 'texts'")
    joined = lambda c: F.array_join(c, "/")
    return graph.chain_depths(t.select(joined("key").alias("key"), F.expr("array_join(try_element_at(try_element_at(refs, 2), 1), '/')").alias("parent"), F.split_part("value", F.lit(" "), F.lit(2)).try_cast("double").alias("size")))


@query("order_chains", """WITH o AS (SELECT o_orderkey AS key, lag(o_orderkey) OVER w AS parent, o_totalprice AS size, row_number() OVER w AS rn, first_value(o_orderkey) OVER w AS root, sum(o_totalprice) OVER w AS total
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT key, rn - 1 AS depth, root, size * 3 AS full_size, (rn - 1 <= 200 AND size * 3 > total) AS as_delta FROM o""")
def _(s, d):
    from pyspark.sql import Window as W

    o = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent"), F.col("o_totalprice").alias("size"))
    c = graph.chain_depths(o).join(o.select("key", (F.col("size") * 3).alias("full_size")), "key")
    return graph.storage_decision(c).drop("total").withColumn("depth", F.col("depth").cast("bigint"))


# ---- trees ----

_E = "e AS (SELECT DISTINCT snapshot, file_id, parent_id, name, kind, revision, text_sha1, text_size, executable, symlink_target, reference_revision FROM entry)"
_STEP = "step AS (SELECT * FROM (SELECT lag(snapshot) OVER (PARTITION BY branch ORDER BY seq) AS older, snapshot FROM (SELECT branch, seq, min(snapshot) AS snapshot FROM inventory GROUP BY ALL)) WHERE older IS NOT NULL)"
_PAIR = f"""{_E}, {_STEP}, n AS (SELECT e.* FROM e JOIN step USING (snapshot)), o AS (SELECT step.snapshot AS snap, e.* FROM e JOIN step ON e.snapshot = step.older),
pair AS (SELECT coalesce(n.snapshot, o.snap) AS snapshot, coalesce(n.file_id, o.file_id) AS file_id, o.file_id IS NOT NULL AS old_versioned, n.file_id IS NOT NULL AS new_versioned,
  {", ".join(f"o.{c} AS old_{c}, n.{c} AS new_{c}" for c in tree.ENTRY)} FROM o FULL JOIN n ON o.snap = n.snapshot AND o.file_id = n.file_id)"""
_CONTENT = """CASE WHEN old_kind IS DISTINCT FROM new_kind THEN true WHEN old_kind = 'file' THEN old_text_sha1 IS DISTINCT FROM new_text_sha1 OR old_executable IS DISTINCT FROM new_executable
  WHEN old_kind = 'symlink' THEN old_symlink_target IS DISTINCT FROM new_symlink_target ELSE false END"""
_CHANGE = f"""change AS (SELECT *, {_CONTENT} AS content_change, ({_CONTENT}) OR (coalesce(old_kind, '') = 'file' AND old_text_size IS DISTINCT FROM new_text_size) AS modified,
  old_parent_id IS DISTINCT FROM new_parent_id OR old_name IS DISTINCT FROM new_name AS renamed FROM pair),
described AS (SELECT *, CASE WHEN NOT old_versioned THEN 'added' WHEN NOT new_versioned THEN 'removed' WHEN modified AND renamed THEN 'modified and renamed' WHEN modified THEN 'modified' WHEN renamed THEN 'renamed' ELSE 'unchanged' END AS change FROM change)"""


@query("tree_changes", f"WITH {_PAIR}, {_CHANGE} SELECT snapshot, file_id, change, content_change, old_versioned, new_versioned, old_parent_id, new_parent_id, old_name, new_name, old_kind, new_kind, old_executable, new_executable FROM described WHERE change <> 'unchanged'")
def _(s, d):
    return tree.changes(*tree_tables(s, d))


@query("tree_change_counts", f"WITH {_PAIR}, {_CHANGE} SELECT snapshot, change, count(*) AS n FROM described GROUP BY ALL")
def _(s, d):
    return tree.paired(*tree_tables(s, d)).groupBy("snapshot", tree.describe().alias("change")).agg(F.count(F.lit(1)).alias("n"))


_PATHS = f"""{_E}, inv AS (SELECT DISTINCT snapshot, root_id FROM inventory),
p AS (SELECT e.snapshot, e.file_id, '' AS path, 0 AS depth FROM e JOIN inv ON inv.snapshot = e.snapshot AND inv.root_id = e.file_id
  UNION ALL SELECT e.snapshot, e.file_id, p.path || '/' || coalesce(e.name, ''), p.depth + 1 FROM e JOIN p ON p.snapshot = e.snapshot AND p.file_id = e.parent_id
  JOIN inv ON inv.snapshot = e.snapshot WHERE e.file_id <> inv.root_id)"""


@query("id_to_path", f"WITH RECURSIVE {_PATHS} SELECT snapshot, file_id, CASE WHEN path = '' THEN '/' ELSE path END AS path, depth FROM p")
def _(s, d):
    return tree.paths(*tree_tables(s, d)).where("state = 'ok'").select("snapshot", "file_id", "path", "depth")


@query("path_to_id", f"WITH RECURSIVE {_PATHS} SELECT snapshot, CASE WHEN path = '' THEN '/' ELSE path END AS path, min(file_id) AS file_id, count(*) AS n_entries FROM p GROUP BY ALL")
def _(s, d):
    return tree.ids_by_path(*tree_tables(s, d))


@query("descendant_counts", f"""WITH RECURSIVE {_PATHS}, up AS (SELECT p.snapshot, p.file_id AS node, e.parent_id AS anc FROM p JOIN e USING (snapshot, file_id) WHERE depth > 0
  UNION ALL SELECT up.snapshot, up.node, e.parent_id FROM up JOIN e ON e.snapshot = up.snapshot AND e.file_id = up.anc JOIN p ON p.snapshot = up.snapshot AND p.file_id = up.anc WHERE p.depth > 0)
SELECT p.snapshot, p.file_id, count(up.node) AS n_descendants FROM p LEFT JOIN up ON up.snapshot = p.snapshot AND up.anc = p.file_id GROUP BY ALL""")
def _(s, d):
    return tree.paths(*tree_tables(s, d)).where("state = 'ok'").select("snapshot", "file_id", "n_descendants")


@query("depth_first_order", f"WITH RECURSIVE {_PATHS}, q AS (SELECT snapshot, CASE WHEN path = '' THEN '/' ELSE path END AS path, min(file_id) AS file_id FROM p GROUP BY ALL) SELECT snapshot, path, file_id, row_number() OVER (PARTITION BY snapshot ORDER BY string_split(path, '/')) AS place FROM q")
def _(s, d):
    return tree.depth_first(*tree_tables(s, d))


@query("directory_first_order", f"""WITH RECURSIVE {_PATHS}, q AS (SELECT snapshot, path, min(file_id) AS file_id FROM p WHERE path <> '' GROUP BY ALL)
SELECT snapshot, path, file_id, row_number() OVER (PARTITION BY snapshot ORDER BY string_split(regexp_extract(path, '^(.*)/[^/]*$', 1, 's'), '/'), regexp_extract(path, '([^/]*)$', 1)) AS place FROM q""")
def _(s, d):
    return tree.directory_first(*tree_tables(s, d))


@query("subtree_filter", f"""WITH RECURSIVE {_PATHS}, w AS (SELECT snapshot, file_id FROM e JOIN p USING (snapshot, file_id) WHERE kind = 'symlink' OR kind = 'tree-reference'),
down AS (SELECT * FROM w UNION SELECT e.snapshot, e.file_id FROM e JOIN down ON e.snapshot = down.snapshot AND e.parent_id = down.file_id),
up AS (SELECT * FROM w UNION SELECT e.snapshot, e.parent_id FROM up JOIN e USING (snapshot, file_id) JOIN p USING (snapshot, file_id) WHERE p.depth > 0)
SELECT DISTINCT snapshot, file_id, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM p JOIN (SELECT * FROM down UNION SELECT * FROM up) USING (snapshot, file_id)""")
def _(s, d):
    e, i = tree_tables(s, d)
    return tree.subtree_filter(e, i, e.join(tree.paths(e, i).where("state = 'ok'"), ["snapshot", "file_id"], "left_semi").where("kind IN ('symlink', 'tree-reference')"))


@query("tree_problems", f"""WITH {_E}, r AS (SELECT DISTINCT snapshot, root_id FROM inventory),
j AS (SELECT e.*, coalesce(e.file_id = r.root_id, false) AS is_root, u.kind AS parent_kind, count(CASE WHEN e.parent_id IS NOT NULL AND e.name IS NOT NULL THEN 1 END) OVER (PARTITION BY e.snapshot, e.parent_id, e.name) AS n_same
  FROM e LEFT JOIN r USING (snapshot) LEFT JOIN e u ON u.snapshot = e.snapshot AND u.file_id = e.parent_id)
SELECT snapshot, file_id, problem FROM (
  SELECT snapshot, file_id, 'parent is missing' AS problem FROM j WHERE NOT is_root AND parent_id IS NOT NULL AND parent_kind IS NULL UNION ALL
  SELECT snapshot, file_id, 'no parent' FROM j WHERE NOT is_root AND parent_id IS NULL UNION ALL SELECT snapshot, file_id, 'parent is not a directory' FROM j WHERE parent_kind <> 'directory' UNION ALL
  SELECT snapshot, file_id, 'bad name' FROM j WHERE NOT is_root AND (name IN ('', '.', '..') OR contains(name, '/')) UNION ALL SELECT snapshot, file_id, 'name occurs twice' FROM j WHERE n_same > 1 UNION ALL
  SELECT snapshot, file_id, 'unknown kind' FROM j WHERE kind NOT IN ('directory', 'file', 'symlink', 'tree-reference'))""")
def _(s, d):
    return tree.tree_problems(*tree_tables(s, d))


@query("children_disagreements", f"""WITH {_E}, l AS (SELECT DISTINCT snapshot, file_id AS parent_id, unnest(map_entries(children)) AS x FROM entry WHERE children IS NOT NULL),
m AS (SELECT snapshot, parent_id, x.key AS name, x.value AS file_id FROM l), r AS (SELECT snapshot, parent_id, name, file_id FROM e WHERE parent_id IS NOT NULL AND name IS NOT NULL)
SELECT *, true AS listed FROM (SELECT * FROM m EXCEPT SELECT * FROM r) UNION ALL SELECT *, false FROM (SELECT * FROM r EXCEPT SELECT * FROM m)""")
def _(s, d):
    return tree.children_disagreements(table(s, d, "entry"))


@query("path_states", f"""WITH {_PAIR}, x AS (SELECT *, old_versioned AND new_versioned AND (old_parent_id IS DISTINCT FROM new_parent_id OR old_name IS DISTINCT FROM new_name) AS moved FROM pair)
SELECT snapshot, file_id, 0 AS tree_index, CASE WHEN NOT new_versioned THEN 'a' ELSE CASE new_kind WHEN 'file' THEN 'f' WHEN 'directory' THEN 'd' WHEN 'symlink' THEN 'l' WHEN 'tree-reference' THEN 't' END END AS kind,
  CASE new_kind WHEN 'file' THEN coalesce(new_text_sha1, '') WHEN 'symlink' THEN coalesce(new_symlink_target, '') WHEN 'tree-reference' THEN coalesce(new_reference_revision, '') ELSE '' END AS fingerprint, coalesce(new_text_size, 0) AS size, coalesce(new_executable, false) AS executable FROM x
UNION ALL SELECT snapshot, file_id, 1, CASE WHEN moved THEN 'r' WHEN NOT old_versioned THEN 'a' ELSE CASE old_kind WHEN 'file' THEN 'f' WHEN 'directory' THEN 'd' WHEN 'symlink' THEN 'l' WHEN 'tree-reference' THEN 't' END END,
  CASE WHEN moved THEN concat_ws('/', old_parent_id, old_name) ELSE CASE old_kind WHEN 'file' THEN coalesce(old_text_sha1, '') WHEN 'symlink' THEN coalesce(old_symlink_target, '') WHEN 'tree-reference' THEN coalesce(old_reference_revision, '') ELSE '' END END, coalesce(old_text_size, 0), coalesce(old_executable, false) FROM x""")
def _(s, d):
    return tree.path_states(*tree_tables(s, d))


# ---- maps ----


@query("map_changes", f"WITH {_PAIR} SELECT snapshot, file_id, old_text_sha1 AS old, new_text_sha1 AS new FROM pair WHERE old_text_sha1 IS DISTINCT FROM new_text_sha1")
def _(s, d):
    e, i = tree_tables(s, d)
    rows, st = tree.distinct_entries(e).select("snapshot", "file_id", F.col("text_sha1").alias("value")), tree.steps(i)
    old = rows.withColumnRenamed("snapshot", "older").join(st, "older").drop("older")
    return contentmap.map_changes(rows.join(st.select("snapshot"), "snapshot"), old, ["snapshot", "file_id"])


_ENDS = "ends AS (SELECT DISTINCT branch, first_value(snapshot) OVER w AS a, last_value(snapshot) OVER w AS b FROM inventory WINDOW w AS (PARTITION BY branch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


@query("map_difference", f"WITH {_ENDS} SELECT file_id AS key, text_sha1 AS value FROM entry JOIN ends ON snapshot = b WHERE text_sha1 IS NOT NULL EXCEPT SELECT file_id, text_sha1 FROM entry JOIN ends ON snapshot = a")
def _(s, d):
    e, i = tree_tables(s, d)
    ends = i.groupBy("branch").agg(F.min_by("snapshot", "seq").alias("a"), F.max_by("snapshot", "seq").alias("b"))
    part = lambda c: e.where("text_sha1 IS NOT NULL").join(ends.select(F.col(c).alias("snapshot")), "snapshot").select(F.col("file_id").alias("key"), F.col("text_sha1").alias("value"))
    return contentmap.multi_root_difference(part("b"), part("a"))


@query("bucket_digests", """WITH t AS (SELECT DISTINCT revision_id AS key, coalesce(inventory_sha1, '') AS value FROM revision WHERE revision_id IS NOT NULL), p AS (
  SELECT substr(sha1(key), 1, 2) AS bucket, count(*) AS n_rows, sha1(string_agg(sha1(key || chr(0) || value), '' ORDER BY sha1(key), sha1(key || chr(0) || value))) AS d FROM t GROUP BY 1)
SELECT bucket, n_rows, sha1(d) AS digest FROM p""")
def _(s, d):
    rows = table(s, d, "revision").where("revision_id IS NOT NULL").select(F.col("revision_id").alias("key"), F.coalesce("inventory_sha1", F.lit("")).alias("value")).distinct()
    return contentmap.bucket_digests(rows)


@query("map_pages", """WITH t AS (SELECT DISTINCT sha1(revision_id) AS key, revision_id AS value FROM revision WHERE revision_id IS NOT NULL), i AS (SELECT unnest(range(0, 41)) AS i),
x AS (SELECT key, i, substr(key, 1, i) AS p, length(key) + length(value) AS n FROM t, i), g AS (SELECT p, sum(n) AS bytes, count(*) AS n_items FROM x GROUP BY 1 HAVING sum(n) <= 4096 OR count(*) = 1),
f AS (SELECT key, min(i) AS i FROM x JOIN g USING (p) GROUP BY 1) SELECT DISTINCT x.p AS page, CAST(g.bytes AS BIGINT) AS bytes, g.n_items FROM f JOIN x USING (key, i) JOIN g USING (p)""")
def _(s, d):
    rows = table(s, d, "revision").where("revision_id IS NOT NULL").select(F.sha1("revision_id").alias("key"), F.col("revision_id").alias("value")).distinct()
    return contentmap.split_pages(rows, 4096)


@query("map_filter", """SELECT DISTINCT array_to_string(key, '/') AS key, value FROM index_node t WHERE index_name = 'texts' AND NOT coalesce(absent, false)
AND (key[1] IN (SELECT key[1] FROM index_node WHERE index_name = 'texts' AND absent) OR key IN (SELECT unnest(refs[2]) FROM index_node WHERE index_name = 'texts'))""")
def _(s, d):
    """Texts of files that lack a version, and all that another text builds on."""
    t = nodes(s, d).where("index_name = 'texts'")
    keys = t.where("absent").select(F.slice("key", 1, 1).alias("key")).unionAll(t.select(F.explode(F.expr("try_element_at(refs, 2)")).alias("key")))
    return flat(contentmap.map_filter(index.present(t).select("key", "value"), keys))


@query("map_apply_delta", "SELECT DISTINCT revision_id AS key, coalesce(inventory_sha1, 'none') AS value FROM revision WHERE revision_id IS NOT NULL")
def _(s, d):
    rows = table(s, d, "revision").where("revision_id IS NOT NULL").select(F.col("revision_id").alias("key"), F.col("inventory_sha1").alias("value")).distinct()
    gone = rows.where("value IS NULL")
    return contentmap.apply_map_delta(rows, gone.select(F.col("key").alias("old"), F.col("key").alias("new"), F.lit("none").alias("value")))


# ---- texts ----


@query("line_stats", r"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) <> chr(10) THEN 1 ELSE 0 END END AS n_lines,
  sha1(coalesce(text, '')) AS sha1, strlen(coalesce(text, '')) AS n_bytes, coalesce(text <> '' AND right(text, 1) <> chr(10), false) AS no_eol FROM documents""")
def _(s, d):
    return text.line_stats(table(s, d, "documents"))


@query("shared_lines", r"""WITH t AS (SELECT doc_id, unnest(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) || chr(10) AS line FROM documents WHERE text <> '')
SELECT sha1(line) AS line_sha1, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM t GROUP BY line""")
def _(s, d):
    return text.shared_lines(table(s, d, "documents"))


@query("deduplicated_store", "SELECT 'sha1:' || sha1(text) AS content_key, min(doc_id) AS first_key, count(*) AS n_keys, max(strlen(text)) AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY text")
def _(s, d):
    return text.by_content(table(s, d, "documents"))


# ---- storage policies: documents laid into blocks by source ----

_LAID = """laid AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(project, '') AS block, coalesce(lang, '') AS prefix, strlen(coalesce(text, '')) AS n FROM documents),
ranges AS (SELECT *, sum(n) OVER (PARTITION BY block ORDER BY doc_id) AS "end", sum(n) OVER (PARTITION BY block) AS length FROM laid)"""


def laid(s, d):
    return table(s, d, "documents").select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("project", F.lit(""))).alias("block"), F.coalesce("lang", F.lit("")).alias("prefix"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))


def ranges(s, d):
    return storage.laid_out(laid(s, d), "block", ["doc_id"], "n")


@query("block_actions", f"""WITH {_LAID}, used AS (SELECT * FROM ranges WHERE prefix <> 'en'), a AS (SELECT block, CAST(sum(n) AS BIGINT) AS used, CAST(max("end") AS BIGINT) AS last, max(length) AS length FROM used GROUP BY 1)
SELECT block, used, last, CASE WHEN used * 2 >= length THEN 'keep' WHEN used * 2 > last THEN 'trim' ELSE 'rebuild' END AS action FROM a""")
def _(s, d):
    return storage.block_actions(ranges(s, d).where("prefix <> 'en'"))


@query("well_used_blocks", f"""WITH {_LAID}, a AS (SELECT block, count(*) AS n, CAST(sum(n) AS BIGINT) AS used, max(length) AS length, count(DISTINCT prefix) AS n_prefixes FROM ranges WHERE prefix <> 'ja' GROUP BY 1)
SELECT block, n, used, n_prefixes, CASE WHEN n = 1 THEN false WHEN used < length * 0.75 THEN false WHEN length >= 3145728 THEN true WHEN n_prefixes > 1 AND length >= 1572864 THEN true ELSE false END AS well_used FROM a""")
def _(s, d):
    return storage.well_used(ranges(s, d).where("prefix <> 'ja'"))


@query("size_batches", f"""WITH {_LAID}, b AS (SELECT block, n, floor((sum(n) OVER (PARTITION BY block ORDER BY doc_id) - n) / 65536) AS batch FROM laid) SELECT block, CAST(batch AS BIGINT) AS batch, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS bytes FROM b GROUP BY 1, 2""")
def _(s, d):
    return storage.size_batches(laid(s, d), "block", ["doc_id"], "n", 65536).groupBy("block", "batch").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("bytes"))


@query("largest_texts", "SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL ORDER BY n_bytes DESC, doc_id LIMIT 100")
def _(s, d):
    return storage.largest(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes")), "n_bytes", "doc_id", 100)


# ---- scalars ----


@query("revision_scalars", r"""SELECT DISTINCT revision_id, string_split_regex(regexp_replace(message, '^[ \t\n\x0B\f\r]+', ''), '[\r\n]')[1] AS summary,
  array_to_string(list_filter(CASE WHEN properties['authors'] IS NOT NULL THEN string_split(properties['authors'], chr(10)) WHEN properties['author'] IS NOT NULL THEN [properties['author']] ELSE [committer] END, lambda x: x IS NOT NULL AND x <> ''), '|') AS authors,
  strftime(make_timestamp(CAST(floor("timestamp") AS BIGINT) * 1000000), '%Y%m%d%H%M%S') AS compact, right(revision_id, 1) = ':' AS reserved,
  strftime(make_timestamp((CAST(floor("timestamp") AS BIGINT) + coalesce(timezone, 0)) * 1000000), '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN coalesce(timezone, 0) < 0 THEN '-' ELSE '+' END
    || lpad(CAST((abs(coalesce(timezone, 0)) // 60) // 60 AS VARCHAR), 2, '0') || lpad(CAST((abs(coalesce(timezone, 0)) // 60) % 60 AS VARCHAR), 2, '0') AS dated FROM revision""")
def _(s, d):
    r = table(s, d, "revision")
    return r.select("revision_id", S.summary_line(F.col("message")).alias("summary"), F.array_join(S.authors(F.col("properties"), F.col("committer")), "|").alias("authors"), S.compact_date(F.col("timestamp")).alias("compact"), S.is_reserved(F.col("revision_id")).alias("reserved"), S.dated(F.col("timestamp"), F.col("timezone")).alias("dated")).distinct()


@query("path_scalars", r"""SELECT doc_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, len(string_split(path, '/')) - 1 AS n_ancestors,
  path = 'src' OR starts_with(path, 'src/') AS inside, replace(replace(replace(replace(replace(path, '&', '&amp;'), '''', '&apos;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents WHERE path IS NOT NULL""")
def _(s, d):
    p = F.col("path")
    return table(s, d, "documents").where("path IS NOT NULL").select("doc_id", S.dirname(p).alias("dir"), S.basename(p).alias("base"), F.size(S.ancestor_paths(p)).cast("bigint").alias("n_ancestors"), S.is_inside(F.lit("src"), p).alias("inside"), S.xml_escaped(p).alias("escaped"))


@query("search_keys", """WITH t AS (SELECT DISTINCT key FROM index_node WHERE len(key) > 0), b AS (SELECT key, unnest(key) AS e, unnest(range(1, len(key) + 1)) AS i FROM t),
x AS (SELECT DISTINCT e, list_transform(range(0, strlen(e)), lambda j: CAST('0x' || substr(hex(encode(e)), CAST(2 * j + 1 AS INT), 2) AS BIGINT)) AS bytes FROM b),
c AS (SELECT e, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda h, v: list_reduce(list_prepend(xor(h, v), [0, 1, 2, 3, 4, 5, 6, 7]), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) AS crc FROM x)
SELECT DISTINCT array_to_string(b.key, '/') AS key, string_agg(lpad(upper(to_hex(crc)), 8, '0'), chr(0) ORDER BY i) AS hash_16 FROM b JOIN c USING (e) GROUP BY b.key, 1""")
def _(s, d):
    k = F.col("k")
    return nodes(s, d).where("size(key) > 0").select(F.col("key").alias("k")).select(F.array_join(k, "/").alias("key"), S.search_key_16(k).alias("hash_16")).distinct()


@query("partitions")
def _(s, d):
    k = F.col("k")
    return nodes(s, d).where("size(key) > 0").select(F.col("key").alias("k")).select(F.array_join(k, "/").alias("key"), S.search_key_255(k).alias("hash_255"), S.hashed_partition(F.element_at(k, 1)).alias("partition"), S.escaped_partition(F.element_at(k, 1)).alias("escaped")).distinct()


@query("stat_fingerprints", """SELECT DISTINCT header_id, base64(unhex(lpad(upper(to_hex(coalesce(num_entries, 0) & 4294967295)), 8, '0') || lpad(upper(to_hex(coalesce(end_of_header, 0) & 4294967295)), 8, '0') || lpad(upper(to_hex(coalesce(end_of_header, 0) & 4294967295)), 8, '0')
  || '00000801' || lpad(upper(to_hex(coalesce(crc_expected, 0) & 4294967295)), 8, '0') || '000081A4')) AS packed FROM dirstate_header""")
def _(s, d):
    c = F.col
    return table(s, d, "dirstate_header").select("header_id", S.packed_stat(c("num_entries"), c("end_of_header"), c("end_of_header"), F.lit(2049), c("crc_expected"), F.lit(33188)).alias("packed")).distinct()


@query("precise_dates", r"""SELECT DISTINCT revision_id, strftime(make_timestamp((CAST(floor("timestamp") AS BIGINT) + coalesce(timezone, 0)) * 1000000), '%a %Y-%m-%d %H:%M:%S') AS head,
  CASE WHEN coalesce(timezone, 0) < 0 THEN '-' ELSE '+' END || lpad(CAST((abs(coalesce(timezone, 0)) // 60) // 60 AS VARCHAR), 2, '0') || lpad(CAST((abs(coalesce(timezone, 0)) // 60) % 60 AS VARCHAR), 2, '0') AS zone, coalesce(timezone, 0) % 60 = 0 AS back FROM revision""")
def _(s, d):
    """Dates with nine decimals, and whether reading them gives the instant again: not where an offset has odd seconds."""
    r = table(s, d, "revision").withColumn("text", S.precise_date(F.col("timestamp"), F.col("timezone")))
    again = S.parse_precise_date(F.col("text"))
    return r.select("revision_id", F.substring_index("text", ".", 1).alias("head"), F.substring_index("text", " ", -1).alias("zone"), (F.abs(again["timestamp"] - F.col("timestamp")) < 1e-5).alias("back")).distinct()

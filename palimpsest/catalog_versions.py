"""Queries over versions of texts, tree deltas and working states, each with the SQL it must equal.

The texts are directory listings: a directory of a snapshot is a text of sorted lines, one a
child, and its version before is the same directory in the snapshot before. Lines of a
listing are unique and sorted, so SQL can say what deltas, origins and merges must be.
"""

from pyspark.sql import functions as F

from palimpsest.catalog_store import _E, _PAIR, _PATHS, _STEP, tree_tables
from palimpsest.operators import text, tree, versions

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- versions of listings ----

_RANK = f"""{_E}, head AS (SELECT branch, snapshot, row_number() OVER (PARTITION BY branch ORDER BY seq) AS rk FROM (SELECT branch, seq, min(snapshot) AS snapshot FROM inventory GROUP BY ALL)),
line AS (SELECT coalesce(h.branch, e.snapshot) AS branch, coalesce(h.rk, 1) AS rk, e.snapshot, e.parent_id AS dir, concat_ws(' ', e.name, e.kind, e.file_id, e.text_sha1) || chr(10) AS line FROM e LEFT JOIN head h USING (snapshot) WHERE e.parent_id IS NOT NULL AND e.name IS NOT NULL),
list AS (SELECT branch, rk, snapshot, dir, dir || '/' || snapshot AS key, string_agg(line, '' ORDER BY line) AS body, count(*) AS n_lines FROM line GROUP BY ALL)"""


def listings(s, d):
    return tree.listings(*tree_tables(s, d))


@query("fulltexts", f"WITH {_RANK} SELECT key, sha1(body) AS sha1, n_lines, true AS intact FROM list")
def _(s, d):
    """Every listing, read back through its delta chain."""
    got = versions.fulltexts(versions.stored(listings(s, d)))
    return got.select("key", F.sha1(F.array_join("lines", "")).alias("sha1"), F.size("lines").cast("bigint").alias("n_lines"), "intact")


@query("line_origins", f"""WITH {_RANK}, run AS (SELECT *, rk - row_number() OVER (PARTITION BY branch, dir, line ORDER BY rk) AS island FROM line),
born AS (SELECT dir, snapshot, line, first_value(snapshot) OVER (PARTITION BY branch, dir, line, island ORDER BY rk) AS since FROM run)
SELECT dir || '/' || snapshot AS key, row_number() OVER (PARTITION BY dir, snapshot ORDER BY line) - 1 AS pos, dir || '/' || since AS origin, line FROM born""")
def _(s, d):
    """The version that brought each line of each listing."""
    return versions.line_origins(listings(s, d)).withColumn("pos", F.col("pos").cast("bigint"))


@query("lines_added", f"""WITH {_RANK}, p AS (SELECT a.key, a.dir, a.rk, a.branch, b.key IS NOT NULL AS has FROM list a LEFT JOIN list b ON b.branch = a.branch AND b.dir = a.dir AND b.rk = a.rk - 1)
SELECT l.dir || '/' || l.snapshot AS key, l.line FROM line l JOIN p ON p.key = l.dir || '/' || l.snapshot WHERE NOT EXISTS (SELECT 1 FROM line o WHERE o.branch = l.branch AND o.dir = l.dir AND o.rk = l.rk - 1 AND o.line = l.line)""")
def _(s, d):
    """The lines that each delta of a listing brings; first versions bring all of theirs."""
    return versions.lines_added(versions.stored(listings(s, d), None))


@query("record_stream", f"""WITH {_RANK}, run AS (SELECT *, rk - row_number() OVER (PARTITION BY branch, dir ORDER BY rk) AS island FROM list),
got AS (SELECT key, sha1(body) AS sha1, row_number() OVER (PARTITION BY branch, dir, island ORDER BY rk) - 1 AS place FROM run), {_STEP},
gone AS (SELECT l.dir || '/' || s.snapshot AS key FROM list l JOIN step s ON s.older = l.snapshot)
SELECT key, 'fulltext' AS storage_kind, sha1, place FROM got UNION ALL SELECT key, 'absent', NULL, NULL FROM gone WHERE key NOT IN (SELECT key FROM list)""")
def _(s, d):
    """All listings and those that a next snapshot lacks, parents before children."""
    v = listings(s, d)
    e, i = tree_tables(s, d)
    after = v.select(F.regexp_extract("key", "^(.*)/([^/]*)$", 1).alias("dir"), F.regexp_extract("key", "([^/]*)$", 1).alias("older")).join(tree.steps(i), "older").select(F.concat_ws("/", "dir", "snapshot").alias("key"))
    asked = v.select("key").unionAll(after).withColumn("ord", F.lit(0))
    got = versions.record_stream(versions.stored(v), asked, "topological")
    return got.select("key", "storage_kind", "sha1", F.col("place").cast("bigint").alias("place"))


def three(s, d):
    """(key, base, a, b): each listing between the versions before and after it."""
    v = listings(s, d)
    base = v.select(F.col("key").alias("parent"), F.col("lines").alias("base"))
    nxt = v.where("parent IS NOT NULL").select(F.col("parent").alias("key"), F.col("lines").alias("b"))
    return v.join(base, "parent").join(nxt, "key").select("key", "base", F.col("lines").alias("a"), "b")


_THREE = f"""{_RANK}, tri AS (SELECT a.key, a.branch, a.dir, a.rk FROM list a WHERE EXISTS (SELECT 1 FROM list o WHERE o.branch = a.branch AND o.dir = a.dir AND o.rk = a.rk - 1) AND EXISTS (SELECT 1 FROM list n WHERE n.branch = a.branch AND n.dir = a.dir AND n.rk = a.rk + 1)),
member AS (SELECT t.key, l.line, bool_or(l.rk < t.rk) AS o, bool_or(l.rk = t.rk) AS a, bool_or(l.rk > t.rk) AS b FROM tri t JOIN line l ON l.branch = t.branch AND l.dir = t.dir AND l.rk BETWEEN t.rk - 1 AND t.rk + 1 GROUP BY ALL)"""


@query("merge_plans", f"""WITH {_THREE} SELECT key, count(*) FILTER (WHERE o AND a AND b) AS unchanged, count(*) FILTER (WHERE o AND NOT a AND b) AS killed_a, count(*) FILTER (WHERE o AND a AND NOT b) AS killed_b,
count(*) FILTER (WHERE o AND NOT a AND NOT b) AS killed_both, count(*) FILTER (WHERE NOT o AND a) AS new_a, count(*) FILTER (WHERE NOT o AND b) AS new_b FROM member GROUP BY key""")
def _(s, d):
    """Lines of each state in the three-way merge plan of each listing and its next version over the one before."""
    plan = text.line_plans(three(s, d))
    n = lambda state: F.count(F.when(F.col("state") == state, 1)).alias(state.replace("-", "_"))
    return plan.groupBy("key").agg(*map(n, ("unchanged", "killed-a", "killed-b", "killed-both", "new-a", "new-b")))


@query("merged_texts", f"""WITH {_THREE}, cut AS (SELECT *, o AND a AND b AS kept, 2 * sum(CASE WHEN o AND a AND b THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY line) - CASE WHEN o AND a AND b THEN 1 ELSE 0 END AS seg FROM member),
side AS (SELECT key, seg, coalesce(string_agg(line, '' ORDER BY line) FILTER (WHERE a), '') AS ta, coalesce(string_agg(line, '' ORDER BY line) FILTER (WHERE b), '') AS tb, bool_or(o <> a) AS ca, bool_or(o <> b) AS cb FROM cut GROUP BY ALL),
part AS (SELECT key, seg, CASE WHEN NOT cb THEN ta WHEN NOT ca OR ta = tb THEN tb ELSE '<<<<<<< ' || chr(10) || ta || '=======' || chr(10) || tb || '>>>>>>> ' || chr(10) END AS x, ca AND cb AND ta <> tb AS c FROM side WHERE ta || tb <> '')
SELECT key, sha1(string_agg(x, '' ORDER BY seg)) AS sha1, count(*) FILTER (WHERE c) AS n_conflicts FROM part GROUP BY key""")
def _(s, d):
    """The merged text of each listing with its next version, conflicts between markers."""
    got = text.merged_texts(text.line_plans(three(s, d)), "key")
    return got.select("key", F.sha1("text").alias("sha1"), "n_conflicts")


@query("two_way_merges", f"""WITH {_THREE}, cut AS (SELECT *, a AND b AS kept, 2 * sum(CASE WHEN a AND b THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY line) - CASE WHEN a AND b THEN 1 ELSE 0 END AS seg FROM member WHERE a OR b),
side AS (SELECT key, seg, coalesce(string_agg(line, '' ORDER BY line) FILTER (WHERE a), '') AS ta, coalesce(string_agg(line, '' ORDER BY line) FILTER (WHERE b), '') AS tb, bool_and(kept) AS kept FROM cut GROUP BY ALL),
part AS (SELECT key, seg, CASE WHEN kept THEN ta ELSE '<<<<<<< ' || chr(10) || ta || '=======' || chr(10) || tb || '>>>>>>> ' || chr(10) END AS x, NOT kept AS c FROM side)
SELECT key, sha1(string_agg(x, '' ORDER BY seg)) AS sha1, count(*) FILTER (WHERE c) AS n_conflicts FROM part GROUP BY key""")
def _(s, d):
    """Each listing merged with its next version without a base."""
    plan = three(s, d).select("key", F.posexplode(text.two_way_column(F.col("a"), F.col("b"))).alias("pos", "x")).select("key", "pos", "x.state", "x.line")
    return text.merged_texts(plan, "key").select("key", F.sha1("text").alias("sha1"), "n_conflicts")


@query("lca_plans", f"""WITH {_THREE} SELECT key, count(*) FILTER (WHERE a AND b) AS unchanged, count(*) FILTER (WHERE a AND NOT b AND NOT o) AS new_a, count(*) FILTER (WHERE a AND NOT b AND o) AS killed_b,
count(*) FILTER (WHERE b AND NOT a AND NOT o) AS new_b, count(*) FILTER (WHERE b AND NOT a AND o) AS killed_a FROM member WHERE a OR b GROUP BY key""")
def _(s, d):
    """Lines of each state when each listing and its next version are merged over the one before as their common ancestor."""
    plan = three(s, d).select("key", F.explode(text.lca_plan_column(F.col("a"), F.col("b"), F.array("base"))).alias("x"))
    n = lambda state: F.count(F.when(F.col("x.state") == state, 1)).alias(state.replace("-", "_"))
    return plan.groupBy("key").agg(*map(n, ("unchanged", "new-a", "killed-b", "new-b", "killed-a")))


@query("multi_parent_diffs", f"""WITH {_THREE} SELECT m.key, count(*) FILTER (WHERE a AND NOT o AND NOT b) AS n_new, count(*) FILTER (WHERE a AND (o OR b)) AS n_copied, sha1(any_value(body)) AS sha1 FROM member m JOIN list USING (key) GROUP BY m.key""")
def _(s, d):
    """Each listing as a diff from the versions before and after it, and the text that the diff gives again."""
    t = three(s, d).select("key", F.array("base", "b").alias("parents"), F.col("a").alias("lines")).withColumn("hunks", text.multi_parent_column(F.col("parents"), F.col("lines")))
    total = lambda old: F.aggregate(F.filter("hunks", lambda h: h["parent"].isNotNull() if old else h["parent"].isNull()), F.lit(0).cast("bigint"), lambda n, h: n + h["n"])
    return t.select("key", total(False).alias("n_new"), total(True).alias("n_copied"), F.sha1(F.array_join(text.multi_parent_text(F.col("parents"), F.col("hunks")), "")).alias("sha1"))


@query("weave_plans", """WITH e AS (SELECT DISTINCT snapshot, file_id, coalesce(text_sha1, '') AS sha FROM entry), head AS (SELECT branch, snapshot, row_number() OVER (PARTITION BY branch ORDER BY seq) AS rk, count(*) OVER (PARTITION BY branch) AS last FROM (SELECT branch, seq, min(snapshot) AS snapshot FROM inventory GROUP BY ALL)),
r AS (SELECT branch, rk, last, file_id || ' ' || sha AS line FROM e JOIN head USING (snapshot)), i AS (SELECT *, rk - row_number() OVER (PARTITION BY branch, line ORDER BY rk) AS island FROM r),
w AS (SELECT branch, line, min(rk) AS ins, max(rk) + 1 AS d, any_value(last) AS last FROM i GROUP BY branch, line, island)
SELECT branch AS weave, CASE WHEN d <= last - 2 THEN 'killed-base' WHEN ins <= last - 2 THEN CASE WHEN d = last - 1 THEN 'killed-a' WHEN d = last THEN 'killed-b' ELSE 'unchanged' END WHEN ins = last - 1 THEN 'new-a' ELSE 'new-b' END AS state, line FROM w WHERE last > 2""")
def _(s, d):
    """Each branch as a weave of its entries, and the merge plan of two versions of it: all but its last snapshot, and all but the one before."""
    from pyspark.sql import Window as W

    e, i = tree_tables(s, d)
    one = i.where("snapshot IS NOT NULL AND branch IS NOT NULL AND seq IS NOT NULL").groupBy("branch", "seq").agg(F.min("snapshot").alias("snapshot"))
    per = W.partitionBy("branch")
    head = one.select("branch", "snapshot", F.row_number().over(per.orderBy("seq")).alias("rk"), F.count(F.lit(1)).over(per).cast("int").alias("last")).where("last > 2")
    r = tree.distinct_entries(e).join(head, "snapshot").select("branch", "rk", "last", F.concat_ws(" ", "file_id", F.coalesce("text_sha1", F.lit(""))).alias("line"))
    runs = r.withColumn("island", F.col("rk") - F.row_number().over(W.partitionBy("branch", "line").orderBy("rk"))).groupBy("branch", "line", "island").agg(F.min("rk").alias("ins"), (F.max("rk") + 1).alias("d"), F.max("last").alias("last"))
    weaves = runs.select(F.col("branch").alias("weave"), F.lit(0).alias("pos"), "ins", F.when(F.col("d") <= F.col("last"), F.array("d")).otherwise(F.array().cast("array<int>")).alias("dels"), "line")
    ranks = lambda hi: F.sequence(F.lit(1), hi)
    pairs = head.select(F.col("branch").alias("weave"), "last").distinct().select("weave", ranks(F.col("last") - 1).alias("a"), F.concat(ranks(F.col("last") - 2), F.array("last")).alias("b"))
    return text.weave_plan(weaves, pairs).drop("pos")


# ---- deltas and edits of trees ----

_DELTA = f"""{_PATHS.replace(_E + ",", _PAIR + ",", 1)}, pp AS (SELECT snapshot, file_id, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM p)"""
_COLS = ", ".join(tree.ENTRY)


def _full(s, d):
    """Paths of every entry that has one, detached ones included."""
    return tree.paths(*tree_tables(s, d))


@query("apply_delta", f"WITH {_E}, {_STEP} SELECT e.* FROM e JOIN step USING (snapshot)")
def _(s, d):
    """Each snapshot as the one before with its delta applied: unchanged entries come from the older tree, all others from the delta."""
    e, i = tree_tables(s, d)
    base = tree.distinct_entries(e).withColumnRenamed("snapshot", "older").join(tree.steps(i), "older").drop("older")
    changes = tree.delta(e, i)
    # entries that no path leads to are named by their ids
    named = changes.withColumn("new_path", F.when(F.col("kind").isNotNull() | F.col("new_path").isNotNull(), F.coalesce("new_path", F.concat(F.lit("?"), "file_id")))).withColumn("old_path", F.coalesce("old_path", F.lit("?")))
    return tree.apply_delta(base, named)


@query("subtree_removal", f"""WITH RECURSIVE {_PATHS}, gone AS (SELECT DISTINCT e.snapshot, e.parent_id AS file_id FROM e JOIN p USING (snapshot, file_id) JOIN inv USING (snapshot) WHERE e.kind = 'symlink' AND p.depth > 1
  UNION SELECT e.snapshot, e.file_id FROM e JOIN gone g ON g.snapshot = e.snapshot AND e.parent_id = g.file_id)
SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.snapshot = e.snapshot AND g.file_id = e.file_id)""")
def _(s, d):
    """All snapshots without the directories below the root that hold a symbolic link, and without what lies below those."""
    e, i = tree_tables(s, d)
    full = _full(s, d)
    links = tree.distinct_entries(e).where("kind = 'symlink'").select("snapshot", "file_id", "parent_id").join(full.where("state = 'ok' AND depth > 1").select("snapshot", "file_id"), ["snapshot", "file_id"], "left_semi")
    return tree.apply_delta(tree.distinct_entries(e), tree.removal(full, links.select("snapshot", F.col("parent_id").alias("file_id"))))


@query("moved_links", f"""WITH RECURSIVE {_PATHS} SELECT e.snapshot, e.file_id, CASE WHEN m THEN inv.root_id ELSE e.parent_id END AS parent_id, CASE WHEN m THEN 'link.' || e.file_id ELSE e.name END AS name, {", ".join("e." + c for c in tree.ENTRY[2:])}
FROM (SELECT e.*, e.kind = 'symlink' AND p.file_id IS NOT NULL AS m FROM e LEFT JOIN p USING (snapshot, file_id)) e LEFT JOIN inv USING (snapshot)""")
def _(s, d):
    """All snapshots with their symbolic links moved to the root under new names."""
    e, i = tree_tables(s, d)
    rows, full = tree.distinct_entries(e), _full(s, d).where("state = 'ok'")
    roots = i.select("snapshot", F.col("root_id").alias("to_parent")).distinct()
    asked = rows.where("kind = 'symlink'").join(full, ["snapshot", "file_id"], "left_semi").join(roots, "snapshot").select("snapshot", "file_id", "to_parent", F.concat(F.lit("link."), "file_id").alias("to_name"))
    return tree.apply_delta(rows, tree.moves(rows, full, asked))


@query("rerooted", f"""WITH {_E}, r AS (SELECT DISTINCT snapshot, root_id FROM inventory) SELECT e.snapshot, CASE WHEN e.file_id = root_id THEN 'root-' || e.snapshot ELSE e.file_id END AS file_id, CASE WHEN e.parent_id = root_id THEN 'root-' || e.snapshot ELSE e.parent_id END AS parent_id,
{", ".join("e." + c for c in tree.ENTRY[1:])} FROM e LEFT JOIN r USING (snapshot)""")
def _(s, d):
    """All snapshots under a new root id."""
    e, i = tree_tables(s, d)
    ids = i.where("root_id IS NOT NULL").select("snapshot", F.col("root_id").alias("file_id"), F.concat(F.lit("root-"), "snapshot").alias("new_id")).distinct()
    return tree.renumbered(tree.distinct_entries(e), ids)


_DIFFER = " OR ".join(f"old_{c} IS DISTINCT FROM new_{c}" for c in tree.ENTRY)


@query("inventory_delta", f"""WITH RECURSIVE {_DELTA}
SELECT pair.snapshot, pair.file_id, o.path AS old_path, n.path AS new_path, new_revision AS revision FROM pair JOIN step USING (snapshot) LEFT JOIN pp o ON o.snapshot = step.older AND o.file_id = pair.file_id AND old_versioned
LEFT JOIN pp n ON n.snapshot = pair.snapshot AND n.file_id = pair.file_id AND new_versioned WHERE NOT old_versioned OR NOT new_versioned OR {_DIFFER}""")
def _(s, d):
    """Deltas between consecutive snapshots, by paths from the root; what no path from the root leads to has none."""
    e, i = tree_tables(s, d)
    return tree.delta(e, i, rooted=True).select("snapshot", "file_id", "old_path", "new_path", "revision")


@query("delta_problems", f"""WITH RECURSIVE {_DELTA}, d AS (SELECT pair.snapshot, pair.file_id, o.path AS old_path, n.path AS new_path FROM pair JOIN step USING (snapshot) LEFT JOIN pp o ON o.snapshot = step.older AND o.file_id = pair.file_id AND old_versioned
LEFT JOIN pp n ON n.snapshot = pair.snapshot AND n.file_id = pair.file_id AND new_versioned WHERE NOT old_versioned OR NOT new_versioned OR {_DIFFER})
SELECT snapshot, file_id AS what, 'no path' AS problem FROM d WHERE old_path IS NULL AND new_path IS NULL UNION ALL SELECT snapshot, file_id, 'repeated file id' FROM d GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT snapshot, old_path, 'repeated old path' FROM d WHERE old_path IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT snapshot, new_path, 'repeated new path' FROM d WHERE new_path IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def _(s, d):
    return tree.delta_problems(tree.delta(*tree_tables(s, d), rooted=True))


@query("at_paths", f"""WITH RECURSIVE {_PATHS}, {_STEP}, q AS (SELECT snapshot, CASE WHEN path = '' THEN '/' ELSE path END AS path, min(file_id) AS file_id FROM p GROUP BY ALL)
SELECT s.snapshot, o.path AS asked, n.file_id, '' AS rest FROM step s JOIN q o ON o.snapshot = s.older JOIN q n ON n.snapshot = s.snapshot AND n.path = o.path""")
def _(s, d):
    """Every path of the snapshot before, looked up in each snapshot; no path leads into a nested tree here."""
    e, i = tree_tables(s, d)
    full = _full(s, d)
    old = full.where("state = 'ok'").select(F.col("snapshot").alias("older"), F.col("path").alias("asked"))
    return tree.at_paths(full, e, old.join(tree.steps(i), "older").select("snapshot", "asked"))


# ---- working states: the newest snapshot of each branch over the two before it ----

_TREES = f"""{_E}, tr AS (SELECT branch AS state_id, snapshot, row_number() OVER (PARTITION BY branch ORDER BY seq DESC) - 1 AS tree_index FROM (SELECT branch, seq, min(snapshot) AS snapshot FROM inventory GROUP BY ALL) QUALIFY tree_index < 3),
x AS (SELECT tr.state_id, tr.tree_index, e.* FROM e JOIN tr USING (snapshot)), ids AS (SELECT DISTINCT state_id, file_id FROM x),
slot AS (SELECT ids.state_id, ids.file_id, tr.tree_index, x.snapshot IS NOT NULL AS here, x.snapshot IS NOT NULL AND z.snapshot IS NOT NULL AND (x.parent_id IS DISTINCT FROM z.parent_id OR x.name IS DISTINCT FROM z.name) AS moved, x.* EXCLUDE (state_id, file_id, tree_index, snapshot)
  FROM ids JOIN tr USING (state_id) LEFT JOIN x ON x.state_id = ids.state_id AND x.file_id = ids.file_id AND x.tree_index = tr.tree_index LEFT JOIN x z ON z.state_id = ids.state_id AND z.file_id = ids.file_id AND z.tree_index = 0),
state AS (SELECT state_id, file_id, tree_index, CASE WHEN NOT here THEN 'a' WHEN moved THEN 'r' ELSE CASE kind WHEN 'file' THEN 'f' WHEN 'directory' THEN 'd' WHEN 'symlink' THEN 'l' WHEN 'tree-reference' THEN 't' END END AS kind, parent_id, name,
  CASE WHEN NOT here THEN '' WHEN moved THEN concat_ws('/', parent_id, name) ELSE coalesce(CASE kind WHEN 'file' THEN text_sha1 WHEN 'symlink' THEN symlink_target WHEN 'tree-reference' THEN reference_revision END, '') END AS fingerprint, coalesce(text_size, 0) AS size, coalesce(executable, false) AS executable FROM slot)"""


def states(s, d):
    from pyspark.sql import Window as W

    e, i = tree_tables(s, d)
    one = i.where("snapshot IS NOT NULL AND branch IS NOT NULL AND seq IS NOT NULL").groupBy("branch", "seq").agg(F.min("snapshot").alias("snapshot"))
    trees = one.select(F.col("branch").alias("state_id"), (F.row_number().over(W.partitionBy("branch").orderBy(F.col("seq").desc())) - 1).alias("tree_index"), "snapshot").where("tree_index < 3")
    return tree.working_states(e, trees)


@query("working_states", f"WITH {_TREES} SELECT * FROM state")
def _(s, d):
    return states(s, d)


@query("state_changes", f"""WITH {_TREES} SELECT s.state_id, s.file_id, CASE WHEN s.kind = 'a' THEN 'added' WHEN t.kind = 'a' THEN 'removed' ELSE 'changed' END AS change FROM state s JOIN state t USING (state_id, file_id) WHERE s.tree_index = 1 AND t.tree_index = 0 AND NOT (s.kind = 'a' AND t.kind = 'a')
AND (s.kind <> t.kind OR s.parent_id IS DISTINCT FROM t.parent_id OR s.name IS DISTINCT FROM t.name OR s.fingerprint <> t.fingerprint OR s.executable <> t.executable)""")
def _(s, d):
    return tree.state_changes(states(s, d), 1, 0)


@query("reset_states", f"""WITH {_TREES}, two AS (SELECT * FROM state WHERE tree_index < 2) SELECT state_id, file_id, tree_index, kind, parent_id, name, fingerprint, size, executable FROM two WHERE EXISTS (SELECT 1 FROM two o WHERE o.state_id = two.state_id AND o.file_id = two.file_id AND o.kind NOT IN ('a', 'r'))""")
def _(s, d):
    return tree.without_trees(states(s, d), 2)


@query("state_problems", f"""WITH {_TREES}, zero AS (SELECT * FROM state WHERE tree_index = 0 AND kind <> 'a') SELECT state_id, file_id, 'in no tree' AS problem FROM state GROUP BY ALL HAVING count(*) FILTER (WHERE kind NOT IN ('a', 'r')) = 0
UNION ALL SELECT z.state_id, z.file_id, CASE WHEN u.file_id IS NULL THEN 'parent is missing' ELSE 'parent is no directory' END FROM zero z LEFT JOIN zero u ON u.state_id = z.state_id AND u.file_id = z.parent_id WHERE z.parent_id IS NOT NULL AND (u.file_id IS NULL OR u.kind <> 'd')""")
def _(s, d):
    return tree.state_problems(states(s, d))

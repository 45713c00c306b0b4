"""Tree snapshots: differences between two trees, deltas and their checks, paths, filters, orders.

A tree is a set of entries of one snapshot; ``steps`` pairs each snapshot with the one before
it in its branch, so that one plan compares all consecutive snapshots at once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.scalars import name_is_valid
from palimpsest.operators.hierarchy import LIMIT, hierarchy
from palimpsest.plans.durable import durable

ENTRY = ["parent_id", "name", "kind", "revision", "text_sha1", "text_size", "executable", "symlink_target", "reference_revision"]

BLOCK = 1 << 16  # places of a depth-first walk that one task looks at together
KINDS_OF = ["string", "string", "string", "string", "string", "bigint", "boolean", "string", "string"]  # types of ENTRY


def distinct_entries(entry: DataFrame) -> DataFrame:
    """Each (snapshot, file_id) once; deliveries differ in arrival only, else the least values count."""
    whole = F.min(F.struct(*ENTRY)).alias("e")
    return entry.where("snapshot IS NOT NULL AND file_id IS NOT NULL").groupBy("snapshot", "file_id").agg(whole).select("snapshot", "file_id", "e.*")


def steps(inventory: DataFrame) -> DataFrame:
    """(older, snapshot) of consecutive snapshots of a branch."""
    one = inventory.where("snapshot IS NOT NULL AND branch IS NOT NULL AND seq IS NOT NULL").groupBy("branch", "seq").agg(F.min("snapshot").alias("snapshot"))
    return one.select(F.lag("snapshot").over(W.partitionBy("branch").orderBy("seq")).alias("older"), "snapshot").where("older IS NOT NULL")


def paired(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """(snapshot, file_id, o, n): the entry in the older and the newer tree of each step, null where it is not there."""
    e, s = distinct_entries(entry), steps(inventory)
    packed = F.struct(*ENTRY)
    new = e.join(s.select("snapshot"), "snapshot").select("snapshot", "file_id", packed.alias("n"))
    old = e.withColumnRenamed("snapshot", "older").join(s, "older").select("snapshot", "file_id", packed.alias("o"))
    return old.join(new, ["snapshot", "file_id"], "full")


def _differ(a: str, b: str, fields: list[str]) -> Column:
    out = F.lit(False)
    for f in fields:
        out = out | ~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def content_changed(o: str = "o", n: str = "n") -> Column:
    """Files by sha1 and executable bit, links by target; other kinds have no content."""
    file = _differ(o, n, ["text_sha1", "executable"])
    link = _differ(o, n, ["symlink_target"])
    return F.when(_differ(o, n, ["kind"]), True).when(F.col(f"{o}.kind") == "file", file).when(F.col(f"{o}.kind") == "symlink", link).otherwise(False)


def describe(o: str = "o", n: str = "n") -> Column:
    """unchanged, added, removed, renamed, modified, or modified and renamed; a new parent is a rename, a new kind a modification."""
    renamed = _differ(o, n, ["parent_id", "name"])
    same_size = F.when(F.col(f"{o}.kind") == "file", _differ(o, n, ["text_size"])).otherwise(False)
    modified = content_changed(o, n) | same_size
    return (
        F.when(F.col(o).isNull(), "added").when(F.col(n).isNull(), "removed")
        .when(modified & renamed, "modified and renamed").when(modified, "modified").when(renamed, "renamed").otherwise("unchanged")
    )


def changes(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """Differences of consecutive trees; entries that differ in revision only are left out."""
    p = paired(entry, inventory).withColumn("change", describe()).where("change <> 'unchanged'")
    both = lambda f: [F.col(f"o.{f}").alias(f"old_{f}"), F.col(f"n.{f}").alias(f"new_{f}")]
    return p.select("snapshot", "file_id", "change", content_changed().alias("content_change"), F.col("o").isNotNull().alias("old_versioned"), F.col("n").isNotNull().alias("new_versioned"), *both("parent_id"), *both("name"), *both("kind"), *both("executable"))


def paths(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """snapshot, file_id, path and the rest of ``hierarchy``'s result for entries with a path."""
    return hierarchy(entry, inventory).where("path IS NOT NULL")


def ids_by_path(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """(snapshot, path, file_id) below the root; of entries that share a path the least id."""
    rooted = paths(entry, inventory).where("state = 'ok'")
    return rooted.groupBy("snapshot", "path").agg(F.min("file_id").alias("file_id"), F.count(F.lit(1)).alias("n_entries"))


def delta(entry: DataFrame, inventory: DataFrame, rooted: bool = False) -> DataFrame:
    """Inventory delta of each step: old_path, new_path, file_id and the newer ENTRY of rows that differ in any field.

    Detached entries are named by the path below their own end, with ``rooted`` not at all.
    """
    p = paths(entry, inventory).where("state = 'ok' OR NOT " + str(rooted)).select("snapshot", "file_id", "path")
    d = paired(entry, inventory).where(F.col("o").isNull() | F.col("n").isNull() | _differ("o", "n", ENTRY))
    old = p.withColumnRenamed("snapshot", "older").withColumnRenamed("path", "old_path")
    return (
        d.join(steps(inventory), "snapshot")
        .join(old, ["older", "file_id"], "left")
        .join(p.withColumnRenamed("path", "new_path"), ["snapshot", "file_id"], "left")
        .select("snapshot", "file_id", F.when(F.col("o").isNotNull(), F.col("old_path")).alias("old_path"), F.when(F.col("n").isNotNull(), F.col("new_path")).alias("new_path"), *_row("n"))
    )


def delta_problems(d: DataFrame) -> DataFrame:
    """Rows of a delta that its checks reject: repeated ids, repeated old or new paths, rows without any path."""
    checks = [("repeated file id", ["snapshot", "file_id"], "true"), ("repeated old path", ["snapshot", "old_path"], "old_path IS NOT NULL"), ("repeated new path", ["snapshot", "new_path"], "new_path IS NOT NULL")]
    out = d.where("old_path IS NULL AND new_path IS NULL").select("snapshot", F.col("file_id").alias("what"), F.lit("no path").alias("problem"))
    for problem, by, where in checks:
        out = out.unionByName(d.where(where).groupBy(*by).count().where("count > 1").select("snapshot", F.col(by[1]).alias("what"), F.lit(problem).alias("problem")))
    return out


def delta_order(d: DataFrame) -> DataFrame:
    """The delta in its canonical order, which is descending, with the place of each row in its snapshot."""
    w = W.partitionBy("snapshot").orderBy(F.coalesce("old_path", F.lit("")).desc(), F.coalesce("new_path", F.lit("")).desc(), F.col("file_id").desc())
    return d.withColumn("place", F.row_number().over(w))


def apply_delta(base: DataFrame, delta: DataFrame) -> DataFrame:
    """snapshot, file_id and ENTRY of each tree after its delta.

    ``base`` has the rows of the tree before, under the name of the new ``snapshot``; ``delta``
    has snapshot, file_id, old_path, new_path and, where new_path is not null, the new values
    of ENTRY. Every base row that a delta row names goes, every row with a new path comes.
    Check deltas with ``invalid_delta`` first: nothing is verified here.
    """
    d = delta.where("file_id IS NOT NULL")
    kept = base.select("snapshot", "file_id", *ENTRY).join(d.where("old_path IS NOT NULL OR new_path IS NOT NULL").select("snapshot", "file_id"), ["snapshot", "file_id"], "left_anti")
    return kept.unionByName(d.where("new_path IS NOT NULL").select("snapshot", "file_id", *ENTRY))


def invalid_delta(base: DataFrame, base_paths: DataFrame, delta: DataFrame) -> DataFrame:
    """(snapshot, what, problem) of delta rows that must not be applied to ``base``.

    Besides ``delta_problems``: old paths that are not the entry's, entries added that exist
    or removed that don't, new paths that don't end in the entry's name, parents that are no
    directory afterwards, and entries left without their parent. ``base_paths`` has snapshot,
    file_id, path. Trees with a problem should keep their base.
    """
    d = delta.where("file_id IS NOT NULL")
    here = base_paths.select("snapshot", "file_id", F.col("path").alias("base_path"))
    known = base.select("snapshot", "file_id", F.lit(True).alias("known"))
    j = d.join(here, ["snapshot", "file_id"], "left").join(known, ["snapshot", "file_id"], "left")
    known_ = F.coalesce("known", F.lit(False))
    at_root = F.col("new_path") == "/"
    checks = [
        (F.col("old_path").isNotNull() & ~known_, "removed entry is not there"),
        (F.col("old_path").isNull() & F.col("new_path").isNotNull() & known_, "added entry is there"),
        (F.col("old_path").isNotNull() & known_ & ~F.col("old_path").eqNullSafe(F.col("base_path")), "old path is another"),
        (F.col("new_path").isNotNull() & ~at_root & (F.regexp_extract("new_path", "([^/]*)$", 1) != F.coalesce("name", F.lit(""))), "new path is not the name"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in checks]), lambda x: x.isNotNull())
    out = delta_problems(delta.select("snapshot", "file_id", "old_path", "new_path")).unionByName(j.select("snapshot", F.col("file_id").alias("what"), F.explode(found).alias("problem")))
    after = apply_delta(base, delta)
    up = after.select("snapshot", F.col("file_id").alias("parent_id"), F.col("kind").alias("parent_kind")).dropDuplicates(["snapshot", "parent_id"])
    touched = d.select("snapshot").distinct()
    loose = after.where("parent_id IS NOT NULL").join(touched, "snapshot", "left_semi").join(up, ["snapshot", "parent_id"], "left")
    problem = F.when(F.col("parent_kind").isNull(), "parent is missing afterwards").when(F.col("parent_kind") != "directory", "parent is no directory afterwards")
    return out.unionByName(loose.select("snapshot", F.col("file_id").alias("what"), problem.alias("problem")).where("problem IS NOT NULL"))


def _row(source: str = "e") -> list[Column]:
    return [F.col(f"{source}.{c}").alias(c) for c in ENTRY]


def at_paths(tree: DataFrame, entry: DataFrame, requests: DataFrame) -> DataFrame:
    """(snapshot, asked, file_id, rest) of requested (snapshot, asked) paths: the entry there, or the nested tree that the path leads into.

    ``rest`` is the path inside the nested tree, empty where the entry itself was found; paths
    that lead nowhere give no row. Of entries that share a path the least id answers.
    """
    ok = tree.where("state = 'ok'").select("snapshot", "path", "file_id")
    kinds = entry.select("snapshot", "file_id", "kind").dropDuplicates(["snapshot", "file_id"])
    known = ok.join(kinds, ["snapshot", "file_id"]).groupBy("snapshot", "path").agg(F.min(F.struct("file_id", "kind")).alias("e"))
    parts = F.split(F.regexp_replace("asked", "^/", ""), "/")
    ways = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("n"), F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("path")))
    asked = requests.where("asked IS NOT NULL").select("snapshot", "asked").distinct().withColumn("parts", parts)
    hit = asked.select("snapshot", "asked", F.size("parts").alias("size"), F.explode(ways).alias("w")).select("snapshot", "asked", "size", "w.n", "w.path").join(known, ["snapshot", "path"])
    whole = (F.col("n") == F.col("size")) | (F.col("asked") == "/")
    fits = hit.where(whole | (F.col("e.kind") == "tree-reference"))
    rest = F.when(whole, "").otherwise(F.array_join(F.slice(F.split(F.regexp_replace("asked", "^/", ""), "/"), F.col("n") + 1, F.col("size")), "/"))
    first = fits.groupBy("snapshot", "asked").agg(F.max(F.struct(whole.cast("int").alias("w"), (-F.col("n")).alias("n"), F.col("e.file_id").alias("file_id"), rest.alias("rest"))).alias("f"))
    return first.select("snapshot", "asked", "f.file_id", "f.rest")


def removal(tree: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Delta that removes the named entries (snapshot, file_id) with all below them; ``tree`` is the result of ``hierarchy``."""
    none = [F.lit(None).cast(k).alias(c) for c, k in zip(ENTRY, KINDS_OF)]
    return _reach(tree, roots, block).where("reach >= at").select("snapshot", "file_id", F.col("path").alias("old_path"), F.lit(None).cast("string").alias("new_path"), *none)


def moves(entry: DataFrame, tree: DataFrame, requests: DataFrame) -> DataFrame:
    """Delta that gives entries (snapshot, file_id) the parent ``to_parent`` and name ``to_name`` (null: as it is)."""
    e = entry.select("snapshot", "file_id", F.struct(*ENTRY).alias("e")).join(requests.select("snapshot", "file_id", "to_parent", "to_name"), ["snapshot", "file_id"])
    p = tree.where("path IS NOT NULL").select("snapshot", "file_id", "path")
    up = p.select("snapshot", F.col("file_id").alias("parent_id"), F.col("path").alias("up"))
    row = [F.coalesce("to_parent", "e.parent_id").alias("parent_id"), F.coalesce("to_name", "e.name").alias("name"), *_row()[2:]]
    new = e.select("snapshot", "file_id", *row).join(p.withColumnRenamed("path", "old_path"), ["snapshot", "file_id"]).join(up, ["snapshot", "parent_id"], "left")
    path = F.concat(F.when(F.col("up") == "/", "").otherwise(F.col("up")), F.lit("/"), "name")
    return new.select("snapshot", "file_id", "old_path", path.alias("new_path"), *ENTRY)


def additions(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """Delta that adds entries (snapshot, file_id, ENTRY) below parents that are there or come with them one level up."""
    p = tree.where("path IS NOT NULL").select("snapshot", F.col("file_id").alias("parent_id"), F.col("path").alias("up"))
    path = F.when(F.col("parent_id").isNull(), "/").otherwise(F.concat(F.when(F.col("up") == "/", "").otherwise(F.col("up")), F.lit("/"), "name"))
    return rows.join(p, ["snapshot", "parent_id"], "left").select("snapshot", "file_id", F.lit(None).cast("string").alias("old_path"), path.alias("new_path"), *ENTRY)


def renumbered(entry: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries under new ids (snapshot, file_id, new_id), parents included: a re-keyed or re-rooted tree."""
    own = ids.select("snapshot", "file_id", "new_id")
    up = own.select("snapshot", F.col("file_id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    e = entry.select("snapshot", "file_id", *ENTRY).join(own, ["snapshot", "file_id"], "left").join(up, ["snapshot", "parent_id"], "left")
    return e.select("snapshot", F.coalesce("new_id", "file_id").alias("file_id"), F.coalesce("new_parent", "parent_id").alias("parent_id"), *ENTRY[1:])


def tree_problems(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """Entries that break a tree's rules: missing or non-directory parents, bad or clashing names, wrong kinds."""
    e = distinct_entries(entry)
    roots = inventory.select("snapshot", F.col("root_id").alias("file_id")).distinct().withColumn("is_root", F.lit(True))
    up = e.select("snapshot", F.col("file_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    j = e.join(roots, ["snapshot", "file_id"], "left").join(up, ["snapshot", "parent_id"], "left")
    clash = e.where("parent_id IS NOT NULL AND name IS NOT NULL").groupBy("snapshot", "parent_id", "name").agg(F.count(F.lit(1)).alias("n_same"))
    j = j.join(clash, ["snapshot", "parent_id", "name"], "left")
    root = F.coalesce("is_root", F.lit(False))
    checks = [
        (~root & F.col("parent_id").isNotNull() & F.col("parent_kind").isNull(), "parent is missing"),
        (~root & F.col("parent_id").isNull(), "no parent"),
        (F.col("parent_kind") != "directory", "parent is not a directory"),
        (~root & F.col("name").isNotNull() & ~name_is_valid(F.col("name")), "bad name"),
        (F.col("n_same") > 1, "name occurs twice"),
        (~F.col("kind").isin("directory", "file", "symlink", "tree-reference"), "unknown kind"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in checks]), lambda x: x.isNotNull())
    return j.select("snapshot", "file_id", F.explode(found).alias("problem"))


def listings(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """(key, parent, lines): each directory of each snapshot as a text of sorted lines, one a named child.

    ``key`` is the directory's id and the snapshot, ``parent`` the key in the snapshot before
    of the branch. A text grows with its directory.
    """
    line = F.concat(F.concat_ws(" ", "name", "kind", "file_id", "text_sha1"), F.lit("\n"))
    e = distinct_entries(entry).where("parent_id IS NOT NULL AND name IS NOT NULL")
    t = e.groupBy("snapshot", "parent_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return t.join(steps(inventory), "snapshot", "left").select(F.concat_ws("/", "parent_id", "snapshot").alias("key"), F.when(F.col("older").isNotNull(), F.concat_ws("/", "parent_id", "older")).alias("parent"), "lines")


def children(entry: DataFrame) -> DataFrame:
    """snapshot, parent_id, name, file_id, kind of every entry that has a parent."""
    return distinct_entries(entry).where("parent_id IS NOT NULL").select("snapshot", "parent_id", "name", "file_id", "kind")


def children_disagreements(entry: DataFrame) -> DataFrame:
    """Names in a directory's children map that no entry confirms, and the reverse."""
    listed = entry.where("children IS NOT NULL").select("snapshot", F.col("file_id").alias("parent_id"), F.explode("children").alias("name", "file_id")).distinct().withColumn("listed", F.lit(1))
    real = children(entry).where("name IS NOT NULL").select("snapshot", "parent_id", "name", "file_id").withColumn("real", F.lit(1))
    return listed.join(real, ["snapshot", "parent_id", "name", "file_id"], "full").where("listed IS NULL OR real IS NULL").select("snapshot", "parent_id", "name", "file_id", F.col("listed").isNotNull().alias("listed"))


def _reach(t: DataFrame, asked: DataFrame, block: int) -> DataFrame:
    """Tree rows with at, last, reach (the furthest end of asked subtrees begun so far) and ahead (the next asked place).

    Two running extremes along the depth-first places, no pairs. Walks are cut into blocks of
    places, and the extremes of earlier and later blocks are carried in, so a snapshot of
    any size is many small groups.
    """
    ask = asked.select("snapshot", "file_id").distinct().withColumn("asked", F.lit(True))
    t = t.where("first_place IS NOT NULL").join(ask, ["snapshot", "file_id"], "left")
    at, last = F.col("first_place"), F.col("first_place") + F.col("n_descendants")
    t = durable(t.select("snapshot", "root", "file_id", "path", at.alias("at"), last.alias("last"), F.when(F.col("asked"), last).alias("ends"), F.when(F.col("asked"), at).alias("begins"), F.floor(at / block).alias("block")))
    by = ["snapshot", "root", "block"]
    sums = t.groupBy(*by).agg(F.max("ends").alias("ends"), F.min("begins").alias("begins"))
    tree = W.partitionBy("snapshot", "root").orderBy("block")
    carried = sums.select(*by, F.max("ends").over(tree.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.min("begins").over(tree.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    walk = W.partitionBy(*by).orderBy("at")
    reach = F.greatest("before", F.max("ends").over(walk.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ahead = F.least("after", F.min("begins").over(walk.rowsBetween(W.currentRow, W.unboundedFollowing)))
    return t.join(carried, by).select("snapshot", "file_id", "path", "at", "last", reach.alias("reach"), ahead.alias("ahead"))


def subtree_filter(entry: DataFrame, inventory: DataFrame, wanted: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """Requested entries (snapshot, file_id) with all their descendants and ancestors, but not siblings.

    An entry lies below a requested one if the furthest end of those begun so far reaches it,
    and above one if the next of them lies before its own end.
    """
    return _reach(hierarchy(entry, inventory, limit=limit), wanted, block).where("reach >= at OR ahead <= last").select("snapshot", "file_id", "path")


def depth_first(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """snapshot, path, place in component order: a directory's subtree follows it at once."""
    p = ids_by_path(entry, inventory)
    w = W.partitionBy("snapshot").orderBy(F.split("path", "/"))
    return p.select("snapshot", "path", "file_id", F.row_number().over(w).alias("place"))


def directory_first(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """snapshot, path, place with all children of a directory before those of the next: (directory, name) order."""
    p = ids_by_path(entry, inventory).where("path <> '/'")
    up = F.split(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/")
    w = W.partitionBy("snapshot").orderBy(up, F.regexp_extract("path", r"([^/]*)$", 1))
    return p.select("snapshot", "path", "file_id", F.row_number().over(w).alias("place"))


_CODES = ("file", "f", "directory", "d", "symlink", "l", "tree-reference", "t")  # fixed values: one-letter kinds


def working_states(entry: DataFrame, trees: DataFrame) -> DataFrame:
    """Long working states built from N trees: state_id, file_id, tree_index, kind, parent_id, name, fingerprint, size, executable.

    ``trees`` has state_id, tree_index (0 is the working tree) and snapshot. Every entry of
    any tree of a state has a row for each of its trees: absent (a) where the tree lacks it,
    relocated (r, fingerprint is where it is) where its parent or name differs from tree 0.
    """
    e = distinct_entries(entry).join(trees.select("state_id", "tree_index", "snapshot").distinct(), "snapshot")
    ids = e.select("state_id", "file_id").distinct().join(trees.select("state_id", "tree_index").distinct(), "state_id")
    now = e.where("tree_index = 0").select("state_id", "file_id", F.col("parent_id").alias("parent0"), F.col("name").alias("name0"), F.lit(True).alias("here0"))
    j = ids.join(e, ["state_id", "tree_index", "file_id"], "left").join(now, ["state_id", "file_id"], "left")
    there = F.col("snapshot").isNotNull()
    moved = there & F.coalesce("here0", F.lit(False)) & (~F.col("parent_id").eqNullSafe(F.col("parent0")) | ~F.col("name").eqNullSafe(F.col("name0")))
    letter = F.element_at(F.create_map(*[F.lit(x) for x in _CODES]), F.col("kind"))
    code = F.when(~there, "a").when(moved, "r").otherwise(letter)
    mark = F.when(moved, F.concat_ws("/", "parent_id", "name")).when(F.col("kind") == "file", F.col("text_sha1")).when(F.col("kind") == "symlink", F.col("symlink_target")).when(F.col("kind") == "tree-reference", F.col("reference_revision"))
    return j.select("state_id", "file_id", "tree_index", code.alias("kind"), "parent_id", "name", F.when(there, F.coalesce(mark, F.lit(""))).otherwise("").alias("fingerprint"), F.coalesce("text_size", F.lit(0)).alias("size"), F.coalesce("executable", F.lit(False)).alias("executable"))


def state_changes(states: DataFrame, source: int, target: int) -> DataFrame:
    """state_id, file_id, change between two trees of working states; one equi-join of the two slots.

    One of them should be tree 0, to whose place relocated slots refer. Changes are added,
    removed, or changed where the kind, place, fingerprint or executable bit differ; sizes don't count.
    """
    slot = lambda k, mark: states.where(F.col("tree_index") == k).select("state_id", "file_id", *[F.col(c).alias(mark + c) for c in ("kind", "parent_id", "name", "fingerprint", "executable")])
    j = slot(source, "s_").join(slot(target, "t_"), ["state_id", "file_id"])
    gone, new = F.col("t_kind") == "a", F.col("s_kind") == "a"
    # a relocated slot holds a place, not a fingerprint: it differs by its place alone
    differs = (F.col("s_kind") != F.col("t_kind")) | ~F.col("s_parent_id").eqNullSafe(F.col("t_parent_id")) | ~F.col("s_name").eqNullSafe(F.col("t_name")) | (F.col("s_fingerprint") != F.col("t_fingerprint")) | (F.col("s_executable") != F.col("t_executable"))
    change = F.when(gone & new, None).when(new, "added").when(gone, "removed").when(differs, "changed")
    return j.select("state_id", "file_id", change.alias("change")).where("change IS NOT NULL")


def with_working_tree(states: DataFrame, rows: DataFrame) -> DataFrame:
    """States whose tree 0 slot is replaced by ``rows`` (state_id, file_id and a slot's columns); other ids lose theirs.

    Slots of other trees stay; a file that no tree has any more loses its rows. New files
    get absent slots in the other trees of their state.
    """
    cols = ["kind", "parent_id", "name", "fingerprint", "size", "executable"]
    trees = states.select("state_id", "tree_index").distinct()
    ids = states.select("state_id", "file_id").unionByName(rows.select("state_id", "file_id")).distinct()
    new = rows.select("state_id", "file_id", F.lit(0).alias("tree_index"), *cols)
    old = states.where("tree_index > 0").select("state_id", "file_id", "tree_index", *cols)
    full = ids.join(trees, "state_id").join(new.unionByName(old), ["state_id", "file_id", "tree_index"], "left").withColumn("kind", F.coalesce("kind", F.lit("a")))
    full = full.withColumn("fingerprint", F.coalesce("fingerprint", F.lit(""))).withColumn("size", F.coalesce("size", F.lit(0))).withColumn("executable", F.coalesce("executable", F.lit(False)))
    alive = full.where("kind NOT IN ('a', 'r')").select("state_id", "file_id").distinct()
    return full.join(alive, ["state_id", "file_id"], "left_semi").select("state_id", "file_id", "tree_index", *cols)


def without_trees(states: DataFrame, keep: int) -> DataFrame:
    """States with their first ``keep`` trees only; files that only dropped trees had go."""
    left = states.where(F.col("tree_index") < keep)
    return left.join(left.where("kind NOT IN ('a', 'r')").select("state_id", "file_id").distinct(), ["state_id", "file_id"], "left_semi")


def state_problems(states: DataFrame) -> DataFrame:
    """(state_id, file_id, problem): repeated slots, missing slots, files that no tree has, parents that tree 0 lacks or that are no directory."""
    n = states.groupBy("state_id").agg(F.count_distinct("tree_index").alias("n_trees"))
    per = states.groupBy("state_id", "file_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tree_index").alias("n_slots"), F.sum((~F.col("kind").isin("a", "r")).cast("int")).alias("n_here")).join(n, "state_id")
    zero = states.where("tree_index = 0 AND kind NOT IN ('a', 'r')")
    up = zero.select("state_id", F.col("file_id").alias("parent_id"), F.col("kind").alias("parent_kind")).dropDuplicates(["state_id", "parent_id"])
    loose = zero.where("parent_id IS NOT NULL").join(up, ["state_id", "parent_id"], "left")
    rows = [
        per.where("n > n_slots").select("state_id", "file_id", F.lit("slot occurs twice").alias("problem")), per.where("n_slots < n_trees").select("state_id", "file_id", F.lit("slot is missing").alias("problem")),
        per.where("n_here = 0").select("state_id", "file_id", F.lit("in no tree").alias("problem")), loose.where("parent_kind IS NULL").select("state_id", "file_id", F.lit("parent is missing").alias("problem")),
        loose.where("parent_kind <> 'd'").select("state_id", "file_id", F.lit("parent is no directory").alias("problem")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def path_states(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """Long working-tree state of each step: one row per entry and tree (0 newer, 1 older) with a one-letter kind.

    An entry that only the other tree has is absent (a); one that has another parent or name there is relocated (r).
    """
    moved = F.col("o").isNotNull() & F.col("n").isNotNull() & _differ("o", "n", ["parent_id", "name"])
    code = lambda side: F.when(F.col(side).isNull(), "a").otherwise(F.element_at(F.create_map(*[F.lit(x) for x in ("file", "f", "directory", "d", "symlink", "l", "tree-reference", "t")]), F.col(f"{side}.kind")))
    finger = lambda side: F.when(F.col(f"{side}.kind") == "file", F.coalesce(f"{side}.text_sha1", F.lit(""))).when(F.col(f"{side}.kind") == "symlink", F.coalesce(f"{side}.symlink_target", F.lit(""))).when(F.col(f"{side}.kind") == "tree-reference", F.coalesce(f"{side}.reference_revision", F.lit(""))).otherwise("")
    rows = F.array(
        F.struct(F.lit(0).alias("tree_index"), code("n").alias("kind"), finger("n").alias("fingerprint"), F.coalesce("n.text_size", F.lit(0)).alias("size"), F.coalesce("n.executable", F.lit(False)).alias("executable")),
        F.struct(F.lit(1).alias("tree_index"), F.when(moved, "r").otherwise(code("o")).alias("kind"), F.when(moved, F.concat_ws("/", "o.parent_id", "o.name")).otherwise(finger("o")).alias("fingerprint"), F.coalesce("o.text_size", F.lit(0)).alias("size"), F.coalesce("o.executable", F.lit(False)).alias("executable")),
    )
    return paired(entry, inventory).select("snapshot", "file_id", F.explode(rows).alias("r")).select("snapshot", "file_id", "r.*")

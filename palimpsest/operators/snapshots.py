"""What changed between the full snapshots of a branch.

Rows shrink to three integers (file hash, snapshot rank, row hash), are bucketed by the
hash of branch and file, sorted in numpy a few buckets at a time, and compared with
searchsorted set differences against the ranks just before and after. A task holds about
CHUNK rows whatever the size of its partition. Full values are fetched for differing keys only.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.plans.skew import small_join

CONTENT = ["parent_id", "name", "kind", "revision", "text_sha1", "text_size", "executable", "symlink_target", "reference_revision"]
CHUNK = 1 << 20  # rows gathered before whole buckets are compared together
KINDS = ["added", "removed", "changed"]
_OUT = "branch_hash long, rank int, file_hash long, change int"


def row_hash(columns: list[str]) -> Column:
    """64 bits of a row's values; nulls are hashed by position, so they equal only nulls."""
    return F.xxhash64(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in columns])


def heads(inventory: DataFrame) -> DataFrame:
    """snapshot, branch_hash, rank (0 is the first of its branch), last: the branch's highest rank."""
    one = inventory.where("snapshot IS NOT NULL AND branch IS NOT NULL AND seq IS NOT NULL").groupBy("branch", "seq").agg(F.min("snapshot").alias("snapshot"))
    per = W.partitionBy("branch")
    return one.select(
        "snapshot",
        F.xxhash64("branch").alias("branch_hash"),
        (F.row_number().over(per.orderBy("seq")) - 1).alias("rank"),
        (F.count(F.lit(1)).over(per) - 1).cast("int").alias("last"),
    )


def differing(branch: np.ndarray, file: np.ndarray, rank: np.ndarray, last: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """branch, rank, file, change of the differences in one bucket; rank is that of the newer snapshot."""
    order = np.lexsort((row, rank, file, branch))
    branch, file, rank, last, row = (a[order] for a in (branch, file, rank, last, row))
    new = np.empty(len(file), bool)
    if len(file):
        new[0] = True
        new[1:] = (branch[1:] != branch[:-1]) | (file[1:] != file[:-1])
    step = np.int64(last.max() + 3) if len(last) else np.int64(1)
    key = (np.cumsum(new) - 1) * step + rank + 1  # sorted; equal keys differ in row hash only
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    branch, file, rank, last, row, key = (a[keep] for a in (branch, file, rank, last, row, key))
    at = np.searchsorted(key, key - 1)
    at[at == len(key)] = 0
    had = key[at] == key - 1 if len(key) else np.zeros(0, bool)
    nxt = np.searchsorted(key, key + 1)
    nxt[nxt == len(key)] = 0
    stays = key[nxt] == key + 1 if len(key) else np.zeros(0, bool)
    added = (rank > 0) & ~had
    removed = (rank < last) & ~stays
    changed = had & (row[at] != row) if len(key) else np.zeros(0, bool)
    pick = [np.flatnonzero(x) for x in (added, removed, changed)]
    i = np.concatenate(pick)
    kind = np.repeat(np.arange(3), [len(p) for p in pick])
    return [branch[i], rank[i] + (kind == 1), file[i], kind]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets, about CHUNK rows at a time; the input is sorted by bucket, the last column."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)])
        rows += b.num_rows
        if rows >= CHUNK:
            cols = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(cols[-1], cols[-1][-1]))
            if cut:
                yield [c[:cut] for c in cols]
            held, rows = [[c[cut:] for c in cols]], rows - cut
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for branch, file, rank, last, row, _ in _whole(batches):
        b, r, f, c = differing(branch, file, rank, last, row)
        for lo in range(0, len(b), 65536):
            s = slice(lo, lo + 65536)
            yield pa.record_batch([pa.array(b[s]), pa.array(r[s].astype(np.int32)), pa.array(f[s]), pa.array(c[s].astype(np.int32))], ["branch_hash", "rank", "file_hash", "change"])


def compact(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """branch_hash, file_hash, rank, last, row_hash of every entry of a named snapshot, once each."""
    rows = entry.where("snapshot IS NOT NULL AND file_id IS NOT NULL").select("snapshot", F.xxhash64("file_id").alias("file_hash"), row_hash(CONTENT).alias("row_hash"))
    joined = small_join(rows, heads(inventory), ["snapshot"], ["file_hash"])
    return joined.groupBy("branch_hash", "file_hash", "rank", "last", "row_hash").agg(F.lit(1).alias("_one")).drop("_one")


def snapshot_changes(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """snapshot, file_id, change of every entry added, removed or changed since the snapshot before.

    Snapshots of a branch are ordered by seq (gaps allowed); the first has no changes. Heads
    without snapshot, branch or seq, and entries without snapshot or file_id are ignored;
    repeated rows count once; null equals null. Of two rows of one entry that differ, the
    one with the least row hash counts. Keys are 64-bit hashes.
    """
    keyed = compact(entry, inventory).select("branch_hash", "file_hash", "rank", "last", "row_hash", F.shiftrightunsigned(F.xxhash64("branch_hash", "file_hash"), 44).alias("bucket"))
    diff = keyed.repartition("branch_hash", "file_hash").sortWithinPartitions("bucket").mapInArrow(_diff, _OUT)
    names = entry.where("file_id IS NOT NULL").select("file_id").distinct().withColumn("file_hash", F.xxhash64("file_id"))
    located = small_join(diff, heads(inventory).select("snapshot", "branch_hash", "rank"), ["branch_hash", "rank"], ["file_hash"])
    return located.join(names, "file_hash").select("snapshot", "file_id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("change") + 1).alias("change"))


def changed_values(entry: DataFrame, inventory: DataFrame) -> DataFrame:
    """The changes with the values of the newer entry, or of the older one where it was removed.

    Only rows of differing keys are aggregated; of rows of one entry that differ, the whole
    row of least hash is given, the one that ``snapshot_changes`` compared.
    """
    found = snapshot_changes(entry, inventory)
    w = W.partitionBy("branch").orderBy("seq")
    one = inventory.where("snapshot IS NOT NULL AND branch IS NOT NULL AND seq IS NOT NULL").groupBy("branch", "seq").agg(F.min("snapshot").alias("snapshot"))
    before = one.select("snapshot", F.lag("snapshot").over(w).alias("older"))
    where = small_join(found, before, ["snapshot"], ["file_id"]).withColumn("at", F.when(F.col("change") == "removed", F.col("older")).otherwise(F.col("snapshot")))
    rows = entry.select(F.col("snapshot").alias("at"), "file_id", F.struct(row_hash(CONTENT).alias("h"), *CONTENT).alias("row"))
    values = where.join(rows, ["at", "file_id"]).groupBy("snapshot", "file_id", "change").agg(F.min("row").alias("row"))
    return values.select("snapshot", "file_id", "change", *[f"row.{c}" for c in CONTENT])

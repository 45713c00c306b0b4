"""Content-addressed maps as rows (map_id, key, value): differences, filters, deltas, digests."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.index import starting_with
from palimpsest.plans.durable import durable


def map_changes(new: DataFrame, basis: DataFrame, by: list[str]) -> DataFrame:
    """(by, old, new) for keys whose values differ; a null old is only in new, a null new only in basis."""
    j = basis.select(*by, F.col("value").alias("old")).join(new.select(*by, F.col("value").alias("new")), by, "full")
    return j.where(~F.col("old").eqNullSafe(F.col("new")))


def multi_root_difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """(key, value) items of any new map that no old map holds, each once."""
    return new.select("key", "value").distinct().join(old.select("key", "value").distinct(), ["key", "value"], "left_anti")


def map_filter(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct rows of exact keys, and for shorter tuples all rows that start with their elements; tuples of any lengths."""
    return starting_with(rows, keys.select(F.col("key").alias("prefix")), []).distinct()


def apply_map_delta(rows: DataFrame, delta: DataFrame) -> DataFrame:
    """(key, value) after deletions (old) and then insertions (new, value) of a delta (old, new, value).

    Inserting a key that exists and is not deleted in the same delta raises when the result is read.
    """
    kept = rows.select("key", "value").join(delta.where("old IS NOT NULL").select(F.col("old").alias("key")), "key", "left_anti")
    put = delta.where("new IS NOT NULL").select(F.col("new").alias("key"), "value")
    both = kept.withColumn("side", F.lit(0)).unionByName(put.withColumn("side", F.lit(1)))
    one = both.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "side").alias("value"))
    return one.select("key", F.when(F.col("n") > 1, F.raise_error(F.lit("an added key exists"))).otherwise(F.col("value")).alias("value"))


FAN = 4096  # rows that a digest page holds on average


def bucket_digests(rows: DataFrame, digits: int = 2) -> DataFrame:
    """Merkle digests: per bucket of ``digits`` hexadecimal digits of the key's hash its rows and a digest of digests.

    Rows (a key each) are laid into pages by more digits of the same hash, as many as keep
    pages at about FAN rows; a page's digest covers its rows' digests in order of key hash, a
    bucket's digest those of its pages in order. Equal contents have equal digests, at any
    number of partitions; pages are found from the number of rows alone.
    """
    line = F.concat_ws("\0", "key", F.coalesce("value", F.lit("")))
    deep, n = digits, rows.count()
    while n > FAN * 16**deep and deep < 40:
        deep += 1
    b = rows.select(F.sha1("key").alias("h"), F.sha1(line).alias("d"))
    digest = lambda: F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "d"))), lambda x: x["d"]), ""))
    pages = b.groupBy(F.substring("h", 1, deep).alias("page")).agg(F.count(F.lit(1)).alias("n"), digest().alias("d"))
    out = pages.select(F.substring("page", 1, digits).alias("bucket"), F.col("page").alias("h"), "n", "d").groupBy("bucket")
    return out.agg(F.sum("n").alias("n_rows"), digest().alias("digest"))


LEAF_PAGE, INNER_PAGE = "chkleaf:", "chknode:"  # fixed values: first lines of a page's text


def common_prefix(keys: Column) -> Column:
    """Longest common prefix of an array of strings: that of the least and the greatest."""
    lo, hi = F.array_min(keys), F.array_max(keys)
    n = F.least(F.length(lo), F.length(hi))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(lo, F.lit(1), i) == F.substring(hi, F.lit(1), i))
    return F.when(F.size(keys) > 0, F.substring(lo, F.lit(1), F.array_max(same)))


def leaf_text(items: Column, most: int, width: int = 1) -> Column:
    """Text of a leaf page from an array of (key, value), in key order, the keys' common prefix written once."""
    ordered = F.array_sort(items)
    n_lines = lambda v: F.size(F.split(v, "\n"))
    prefix = F.coalesce(common_prefix(F.transform(ordered, lambda x: x["key"])), F.lit(""))
    body = F.transform(ordered, lambda x: F.concat(F.substring(F.concat(x["key"], F.lit("\0"), n_lines(x["value"]).cast("string"), F.lit("\n")), F.length(prefix) + 1, F.lit(2**31 - 1)), x["value"], F.lit("\n")))
    return F.concat(F.lit(f"{LEAF_PAGE}\n{most}\n{width}\n"), F.size(items).cast("string"), F.lit("\n"), prefix, F.lit("\n"), F.array_join(body, ""))


def inner_text(children: Column, n_items: Column, prefix: Column, most: int, width: int = 1) -> Column:
    """Text of an inner page from an array of (prefix, page) in order, all of which start with ``prefix``."""
    lines = F.transform(F.array_sort(children), lambda x: F.concat(F.substring(x["prefix"], F.length(prefix) + 1, F.lit(2**31 - 1)), F.lit("\0"), x["page"], F.lit("\n")))
    return F.concat(F.lit(f"{INNER_PAGE}\n{most}\n{width}\n"), n_items.cast("string"), F.lit("\n"), prefix, F.lit("\n"), F.array_join(lines, ""))


def parse_leaf(text: str) -> dict:
    """maximum, width, prefix and (key, value) items of a leaf page's text."""
    kind, most, width, n, prefix, *rest = text.split("\n")
    if kind != LEAF_PAGE or not rest or rest.pop():
        raise ValueError("not a leaf page")
    items, at = [], 0
    while at < len(rest):
        *key, count = (prefix + rest[at]).split("\0")
        if len(key) != int(width) or at + 1 + int(count) > len(rest):
            raise ValueError("a page that is cut short")
        items.append((tuple(key), "\n".join(rest[at + 1 : at + 1 + int(count)])))
        at += 1 + int(count)
    if len(items) != int(n):
        raise ValueError("another number of items than said")
    return {"maximum": int(most), "width": int(width), "prefix": prefix, "items": items}


def parse_inner(text: str) -> dict:
    """maximum, width, number of items, prefix and (prefix, page) children of an inner page's text."""
    kind, most, width, n, prefix, *rest = text.split("\n")
    if kind != INNER_PAGE or not rest or rest.pop() or not rest:
        raise ValueError("not an inner page")
    children = [tuple((prefix + line).rsplit("\0", 1)) for line in rest]
    if any(len(c) != 2 for c in children):
        raise ValueError("a child without its page")
    return {"maximum": int(most), "width": int(width), "n": int(n), "prefix": prefix, "children": children}


def built_map(rows: DataFrame, most: int) -> DataFrame:
    """(page, prefix, depth, text): every page of the map of (key, value) rows with unique keys, by content; the root has depth 0.

    A key's place is the SHA-1 of it, so no place begins another. Leaves are the pages of
    ``split_pages`` over places; inner pages are built from the deepest up, a level a round:
    rounds follow the length of the longest leaf prefix, not the number of rows. Equal
    contents have equal pages.
    """
    placed = rows.select(F.sha1("key").alias("place"), "key", F.coalesce("value", F.lit("")).alias("value"))
    leaves = split_pages(placed.select(F.col("place").alias("key"), F.concat("key", "value").alias("value")), most).select(F.col("page").alias("prefix"))
    lengths_ = [r[0] for r in leaves.select(F.length("prefix")).distinct().collect()]  # at most 41
    ways = F.array(*[F.lit(n) for n in sorted(lengths_)]) if lengths_ else F.array().cast("array<int>")
    at = placed.withColumn("prefix", F.explode(F.transform(ways, lambda n: F.substring("place", F.lit(1), n)))).join(leaves, "prefix", "left_semi")
    text = leaf_text(F.collect_list(F.struct("key", "value")), most)
    level = durable(at.groupBy("prefix").agg(text.alias("text"), F.count(F.lit(1)).alias("n")).withColumn("page", F.concat(F.lit("sha1:"), F.sha1("text"))))
    done, rest = level, level.select("prefix", "page", "n")
    for depth in range(max(lengths_, default=0), 0, -1):
        here = F.length("prefix") == depth
        up = rest.where(here).groupBy(F.substring("prefix", 1, depth - 1).alias("up")).agg(F.collect_list(F.struct("prefix", "page")).alias("children"), F.sum("n").alias("n"))
        made = up.withColumn("text", inner_text(F.col("children"), F.col("n"), F.col("up"), most))
        made = durable(made.select(F.col("up").alias("prefix"), "text", "n", F.concat(F.lit("sha1:"), F.sha1("text")).alias("page")))
        done = done.unionByName(made)
        rest = rest.where(~here).unionByName(made.select("prefix", "page", "n"))
    return done.select("page", "prefix", F.length("prefix").alias("depth"), "text")


def split_pages(rows: DataFrame, most: int) -> DataFrame:
    """Pages of a search-key trie: the shortest prefix of each key below which at most ``most`` bytes lie.

    One digit a round: a page that is too large is split by the next digit, all others are
    done, so a key is looked at as often as its page's prefix is long, never per prefix of
    its own. A page of a single key is never split; keys that end are pages of their own.
    Rows of one key lie in one page.
    """
    at = rows.select("key", (F.length("key") + F.length(F.coalesce("value", F.lit("")))).cast("bigint").alias("n"))
    at = at.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    done, depth = None, 0
    while True:
        page = F.substring("key", 1, depth)
        sums = at.groupBy(page.alias("page")).agg(F.sum("n").alias("bytes"), F.sum("k").alias("n_items"), F.count(F.lit(1)).alias("keys"), F.max(F.length("key")).alias("longest"))
        sums = durable(sums)
        over = (F.col("bytes") > most) & (F.col("keys") > 1) & (F.col("longest") > depth)
        fits = sums.where(~over).select("page", "bytes", "n_items")
        done = fits if done is None else done.unionByName(fits)
        large = sums.where(over).select("page")
        if large.isEmpty():
            return done
        at = at.withColumn("page", page).join(large, "page", "left_semi").drop("page")
        depth += 1

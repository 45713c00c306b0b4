"""Queries that send whole tables through the file formats and back, and through a record stream."""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from palimpsest import catalog_versions
from palimpsest.catalog_store import _COMBINED
from palimpsest.operators import index, tree
from palimpsest.sources import formats, pages, records, wire
from palimpsest.plans.durable import shared_folder
from palimpsest.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def none(x):
    return None if x is None or x != x or x is pd.NaT else x


@query("entry_lines", "SELECT DISTINCT snapshot, file_id, parent_id, coalesce(name, '') AS name, kind, revision, CASE WHEN kind = 'file' THEN text_sha1 END AS text_sha1, CASE WHEN kind = 'file' THEN text_size END AS text_size FROM entry")
def _(s, d):
    rows = tree.distinct_entries(table(s, d, "entry"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                r = {k: none(v) for k, v in r.items()}
                size = r["text_size"]
                back = formats.parse_entry(formats.entry_text(r | {"text_size": None if size is None else int(size)}))
                out.append({"snapshot": r["snapshot"], **{k: back[k] for k in ("file_id", "parent_id", "name", "kind", "revision", "text_sha1", "text_size")}})
            df = pd.DataFrame(out)
            yield df.astype({"text_size": "Int64"}) if len(df) else df

    return rows.mapInPandas(run, "snapshot string, file_id string, parent_id string, name string, kind string, revision string, text_sha1 string, text_size bigint")


@query("revision_records", "SELECT DISTINCT revision_id, coalesce(committer, '') AS committer, coalesce(message, '') AS message, coalesce(timezone, 0) AS timezone FROM revision")
def _(s, d):
    rows = table(s, d, "revision").select("revision_id", "committer", "message", "timezone").distinct()

    def run(batches):
        for b in batches:
            out = []
            for rid, c, m, z in zip(b["revision_id"], b["committer"], b["message"], b["timezone"]):
                x = formats.bdecode(formats.bencode([["id", rid], ["committer", none(c) or ""], ["message", none(m) or ""], ["timezone", int(none(z) or 0)]]))
                out.append((x[0][1].decode(), x[1][1].decode(), x[2][1].decode(), x[3][1]))
            yield pd.DataFrame(out, columns=["revision_id", "committer", "message", "timezone"])

    return rows.mapInPandas(run, "revision_id string, committer string, message string, timezone int")


@query("containers", "SELECT doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents")
def _(s, d):
    def run(batches):
        for b in batches:
            data = formats.container_bytes([([str(i)], (none(t) or "").encode()) for i, t in zip(b["doc_id"], b["text"])])
            got = list(formats.parse_container(data))
            yield pd.DataFrame({"doc_id": [int(r["names"][0]) for r in got], "sha1": [hashlib.sha1(r["body"]).hexdigest() for r in got]})

    return table(s, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id bigint, sha1 string")


@query("text_records", r"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) <> chr(10) THEN 1 ELSE 0 END END AS n_lines, coalesce(text <> '' AND right(text, 1) <> chr(10), false) AS no_eol, sha1(coalesce(text, '') || CASE WHEN coalesce(text <> '' AND right(text, 1) <> chr(10), false) THEN chr(10) ELSE '' END) AS sha1 FROM documents")
def _(s, d):
    """Each document written as a text record and read back: what is counted and hashed is the text that was read."""
    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"]):
                parts = (none(t) or "").split("\n")
                lines, bare = records.without_eol([*(x + "\n" for x in parts[:-1]), *([parts[-1]] if parts[-1] else [])])
                version, back, digest = records.parse_text_record(records.text_record(str(i), lines), str(i))
                out.append((int(version), len(back), bare, hashlib.sha1("".join(back).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_lines", "no_eol", "sha1"])

    return table(s, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_lines bigint, no_eol boolean, sha1 string")


@query("wire_records", "SELECT doc_id, 'text/' || doc_id AS key, CASE WHEN doc_id > 0 THEN 'text/' || (doc_id // 2) END AS parent, sha1(coalesce(text, '')) AS sha1 FROM documents")
def _(s, d):
    """Documents sent as single records, closures of deltas and blocks in turn, and read back from the stream."""
    def run(batches):
        for b in batches:
            messages = []
            for i, t in zip(b["doc_id"], b["text"]):
                key, parents, body = ("text", str(i)), [("text", str(i // 2))] if i else None, (none(t) or "").encode()
                if i % 3 == 0:
                    messages.append(wire.record("fulltext", key, parents, False, body))
                elif i % 3 == 1:
                    messages.append(wire.closure(False, [key], [{"key": key, "parents": parents, "method": "fulltext", "bare_end": False, "next": None, "body": body}]))
                else:
                    messages.append(wire.block([(key, parents, 0, len(body))], body))
            got = list(wire.parse_stream(messages))
            yield pd.DataFrame({"doc_id": [int(r["key"][1]) for r in got], "key": ["/".join(r["key"]) for r in got], "parent": ["/".join(r["parents"][0]) if r["parents"] else None for r in got], "sha1": [hashlib.sha1(r["body"]).hexdigest() for r in got]})

    return table(s, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id bigint, key string, parent string, sha1 string")


@query("paged_index_files", f"""WITH {_COMBINED} SELECT index_name, array_to_string(key, '/') AS key, coalesce(value, '') AS value, len(flatten(refs)) AS n_refs FROM combined""")
def _(s, d):
    """The combined index written to paged files and read back."""
    rows = pages.parsed_paged_indices(pages.write_paged_indices(index.combined(table(s, d, "index_node"))))
    return rows.select("index_name", F.array_join("key", "/").alias("key"), "value", F.size(F.flatten("refs")).cast("bigint").alias("n_refs"))


@query("index_files", f"""WITH {_COMBINED}, named AS (SELECT DISTINCT index_name, unnest(flatten(refs)) AS key FROM combined)
SELECT index_name, array_to_string(key, '/') AS key, false AS absent, coalesce(value, '') AS value FROM combined UNION ALL
SELECT DISTINCT n.index_name, array_to_string(n.key, '/'), true, NULL FROM named n WHERE NOT EXISTS (SELECT 1 FROM combined c WHERE c.index_name = n.index_name AND c.key = n.key)""")
def _(s, d):
    """The combined index in files of keys by hash: what only other files hold, or none, is absent in a file that refers to it."""
    rows = formats.parsed_graph_indices(formats.write_graph_indices(index.combined(table(s, d, "index_node"))))
    one = rows.groupBy("index_name", "key").agg(F.min("absent").alias("absent"), F.max("value").alias("value"))
    return one.select("index_name", F.array_join("key", "/").alias("key"), "absent", "value")


@query("binary_deltas", f"""WITH {catalog_versions._RANK} SELECT a.key, strlen(a.body) AS n_bytes, sha1(a.body) AS sha1 FROM list a JOIN list o ON o.branch = a.branch AND o.dir = a.dir AND o.rk = a.rk - 1""")
def _(s, d):
    """Each directory listing restored from the byte delta to the version before it."""
    v = catalog_versions.listings(s, d).select("key", "parent", F.encode(F.array_join("lines", ""), "utf-8").alias("newer"))
    pairs = v.join(v.select(F.col("key").alias("parent"), F.col("newer").alias("older")), "parent").select("key", "older", "newer")

    def run(batches):
        for b in batches:
            got = [records.apply_binary_delta(o, records.binary_delta(o, n)) for o, n in zip(b["older"], b["newer"])]
            yield pd.DataFrame({"key": b["key"], "n_bytes": [len(x) for x in got], "sha1": [hashlib.sha1(x).hexdigest() for x in got]})

    return pairs.mapInPandas(run, "key string, n_bytes bigint, sha1 string")


@query("stream_records", """WITH RECURSIVE t AS (SELECT DISTINCT key[1] AS file_id, key[2] AS rev, refs[2][1][2] AS basis FROM index_node WHERE index_name = 'texts' AND NOT coalesce(absent, false)),
r AS (SELECT file_id, rev FROM t WHERE basis IS NULL UNION SELECT t.file_id, t.rev FROM t JOIN r ON t.file_id = r.file_id AND t.basis = r.rev) SELECT file_id, rev FROM r""")
def _(s, d):
    """Index rows of texts as a stream: each passed on once, after the text that it builds on."""
    from palimpsest.streaming.records import insert_records

    batch = index.present(table(s, d, "index_node")).where("index_name = 'texts'")
    out = f"{shared_folder(s).rstrip('/')}/stream-{s.sparkContext.applicationId}-{s.range(1).selectExpr('uuid()').first()[0]}"
    stream = s.readStream.schema(table(s, d, "index_node").schema).parquet(f"{d}/index_node.parque*").where("index_name = 'texts' AND NOT coalesce(absent, false)")
    rows = lambda df: df.select(F.element_at("key", 1).alias("file_id"), F.element_at("key", 2).alias("rev"), F.expr("try_element_at(try_element_at(try_element_at(refs, 2), 1), 2)").alias("basis"), F.col("value").alias("payload"))
    rows(batch)  # the stream and the table have the same columns
    q = insert_records(rows(stream)).where("state = 'inserted'").writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema("file_id string, rev string, basis string, payload string, state string").parquet(f"{out}/rows").select("file_id", "rev")

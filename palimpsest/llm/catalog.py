"""Queries of the text operators over the store's tables."""

from pyspark.sql import functions as F

from palimpsest.llm import aliases, garbled, mixing, pii, repetition, tokens
from palimpsest.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents")


def _revs(spark, d):
    return table(spark, d, "revision")


QUERIES = {
    "p1_found": lambda s, d: pii.personal_fields(_revs(s, d)),
    "p1_redacted": lambda s, d: pii.personal(_revs(s, d)),
    "p2_found": lambda s, d: garbled.garbled_fields(_revs(s, d)),
    "p2_restored": lambda s, d: garbled.garbled(_revs(s, d)),
    "p6_found": lambda s, d: aliases.variants(_revs(s, d)),
    "p6_entities": lambda s, d: aliases.entities(_revs(s, d)),
    "p7_ids": lambda s, d: tokens.encode_corpus(_docs(s, d)),
    "p7_decoded": lambda s, d: tokens.decode_corpus(tokens.encode_corpus(_docs(s, d))).select("doc_id", F.sha1("text").alias("sha1")),
    "p8_mix": lambda s, d: mixing.mix(_docs(s, d), table(s, d, "mix_target")),
    "p8_shares": lambda s, d: mixing.shares(_docs(s, d), table(s, d, "mix_target")),
    "p8_marginals": lambda s, d: mixing.marginals(_docs(s, d), table(s, d, "mix_target")),
    "p8_kept": lambda s, d: mixing.kept(_docs(s, d), table(s, d, "mix_target")),
    "p9_found": lambda s, d: repetition.repetitive(_docs(s, d)),
    "p9_shares": lambda s, d: repetition.repetition(_docs(s, d), every=True).select("doc_id", "n_letters", "share"),
    "p9_bands": lambda s, d: repetition.repetition(_docs(s, d)).select("doc_id", "ratio", "chunk_ratio", "band"),
}

_P9 = """
WITH t AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}]+', '', 'g') AS s FROM documents),
grams AS (SELECT doc_id, unnest(range(1, length(s) - 18)) AS i, s FROM t WHERE length(s) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, substr(s, i, 20) ORDER BY i) AS rn FROM grams),
cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM g WHERE rn > 1),
share AS (SELECT doc_id, count(*) AS n FROM cover GROUP BY 1)
"""

ORACLE: dict[str, str] = {
    "p7_decoded": "SELECT doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents",
    "p8_kept": "SELECT source, max(target_share) AS target_share, max(max_repeats) AS max_repeats, true AS share_met, true AS cap_kept FROM mix_target WHERE source IN (SELECT source FROM documents WHERE text <> '') GROUP BY 1",
    "p9_found": _P9 + "SELECT t.doc_id FROM t JOIN share USING (doc_id) WHERE n >= 0.35 * length(s)",
    "p9_shares": _P9 + "SELECT t.doc_id, coalesce(length(s), 0) AS n_letters, coalesce(n / length(s), 0.0) AS share FROM t LEFT JOIN share USING (doc_id)",
}

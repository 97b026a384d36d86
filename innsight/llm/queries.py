"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm.conversation_trie import conversations, prefix_trie
from innsight.llm.cover_tree import near_duplicates
from innsight.llm.decontaminate import find_items
from innsight.llm.exact_dedup import exact_groups
from innsight.llm.filter_audit import audit
from innsight.llm.language_id import fit_dictionaries, identify
from innsight.llm.ngram_join import jaccard_components
from innsight.llm.packing import pack, token_pieces
from innsight.llm.pii import pseudonymise
from innsight.llm.suffix_dedup import remove_repeats
from innsight.llm.token_counts import token_counts
from innsight.llm.url_filter import filter_urls
from innsight.llm.warc import archive_pages

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PSEUDONYM_KEY = "registered-query-key"  # a deployment passes its own secret
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), RANKS)


def op2_packing(spark, sf_dir):
    packed = pack(token_pieces(table(spark, sf_dir, "documents"), TOKENIZER, added_tokens=True))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_ngram_join(spark, sf_dir):
    found = jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op4_pii(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op5_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), digest_only=True)


def op6_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    # A page shows the document whose id its path holds; the document's labels are the page's.
    labels = table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("key"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int").alias("bad"))
    shown = F.regexp_extract(F.col("url"), r"://[^/?#]*[^?#]*/(\d+)", 1).try_cast("long")
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, bad, label_key=shown)


def op8_warc(spark, sf_dir):
    captures = archive_pages(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    dictionaries = fit_dictionaries(docs.where("NOT held_out"))
    return identify(docs, dictionaries, keep=["doc_id", "held_out"])


def op10_decontaminate(spark, sf_dir):
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op12_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_trie(spark, sf_dir):
    spliced = F.crc32(F.col("conv_id").cast("string")) % 6
    return prefix_trie(conversations(table(spark, sf_dir, "conversations"), block=100, spliced=spliced))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_packing": op2_packing,
        "op3_ngram_join": op3_ngram_join,
        "op4_pii": op4_pii,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_warc": op8_warc,
        "op9_language_id": op9_language_id,
        "op10_decontaminate": op10_decontaminate,
        "op11_embedding_near_dedup": op11_embedding_near_dedup,
        "op12_filter_audit": op12_filter_audit,
        "op13_conversation_trie": op13_conversation_trie,
    }


_OP6 = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


_OP3 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = t.doc_id) AS component_id FROM t LEFT JOIN n USING (doc_id)
"""

_OP8 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to FROM q
"""

_OP10 = r"""
WITH i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
z AS (SELECT DISTINCT least(len(w), 5) AS z FROM i WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, z, unnest(list_transform(range(1, len(w) - z + 2), lambda k: array_to_string(w[k:k + z - 1], ' '))) AS g FROM i JOIN z ON z = least(len(w), 5)),
m AS (SELECT item_id, z, count(*) AS m FROM q GROUP BY ALL),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, z, unnest(list_transform(range(1, len(w) - z + 2), lambda k: array_to_string(w[k:k + z - 1], ' '))) AS g FROM d, z WHERE len(w) >= z),
h AS (SELECT doc_id, item_id, z, count(*) AS n FROM s JOIN q USING (z, g) GROUP BY ALL)
SELECT doc_id, item_id, m AS item_shingles, n AS shared, n / m AS containment FROM h JOIN m USING (item_id, z) WHERE 100 * n >= 80 * m
"""


_OP11 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM f a JOIN f b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT r AS a, r AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
k AS (SELECT c.a, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.b GROUP BY c.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN k ON k.a = v.r LEFT JOIN n ON n.a = v.r
"""

_OP12 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
x AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)] AS bad FROM d LEFT JOIN l USING (doc_id)),
o AS (SELECT '' AS p UNION ALL SELECT p || f FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(f) WHERE NOT contains(p, f)),
p AS (SELECT p, list_transform(string_split(p, ''), lambda f: ascii(f) - 64) AS ix FROM o WHERE length(p) = 5),
m AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
s AS (SELECT part, p, k, bad[ix[k]] AS fails, list_bool_or(list_transform(ix[1:k - 1], lambda i: bad[i])) AS before, len(list_filter(bad, lambda b: b)) AS failed, n, good, toxic
  FROM m, p, unnest(range(1, 6)) AS u(k)),
g AS (SELECT part, p, k,
    sum(CASE WHEN fails AND NOT coalesce(before, FALSE) THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND coalesce(before, FALSE) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT coalesce(before, FALSE) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails AND NOT coalesce(before, FALSE) THEN toxic ELSE 0 END) AS toxic_lost, sum(CASE WHEN fails OR coalesce(before, FALSE) THEN 0 ELSE n END) AS kept
  FROM s GROUP BY ALL)
SELECT part, p AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, p[k]) AS BIGINT) AS shapley FROM g
"""

# crc32 of a decimal id, bit by bit: -1 stands for a shift.
_CRC32 = """xor(list_reduce(flatten(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END) END, CAST(4294967295 AS BIGINT)), 4294967295)"""

_OP13 = f"""
WITH t AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS own FROM t GROUP BY conv_id),
h AS (SELECT o.conv_id, own, coalesce(b.head, []) AS head, {_CRC32.format(c='o.conv_id')} % 6 AS h
  FROM o LEFT JOIN (SELECT conv_id AS base, own AS head FROM o) b ON b.base = o.conv_id - o.conv_id % 100),
s AS (SELECT conv_id, list_concat(head[1:h], own[h + 1:]) AS s FROM h),
m AS (SELECT conv_id, len(s) AS size, d, sha256(array_to_string(list_transform(s[1:d], lambda x: x.k), '')) AS node,
    CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(s[1:d - 1], lambda x: x.k), '')) END AS parent, CASE WHEN d > 0 THEN s[d].n ELSE 0 END AS chars
  FROM s, unnest(range(0, len(s) + 1)) AS u(d)),
g AS (SELECT node, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = size), '')) AS ends_sha256 FROM m GROUP BY node, d),
c AS (SELECT parent, count(*) AS n FROM g GROUP BY parent),
a AS (SELECT DISTINCT x.node AS top, y.node FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.d <= y.d),
z AS (SELECT top, sum(saved) AS saved_tokens, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves FROM a JOIN g USING (node) LEFT JOIN c ON c.parent = g.node GROUP BY top)
SELECT g.conv_id, g.d AS depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(c.n, 0) AS n_children, CAST(z.n_leaves AS BIGINT) AS n_leaves,
  CAST(z.saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN z ON z.top = g.node LEFT JOIN g p ON p.node = g.parent LEFT JOIN c ON c.parent = g.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_embedding_near_dedup": _OP11, "op12_filter_audit": _OP12, "op13_conversation_trie": _OP13, "op3_ngram_join": _OP3, "op6_exact_dedup": _OP6, "op8_warc": _OP8, "op10_decontaminate": _OP10}

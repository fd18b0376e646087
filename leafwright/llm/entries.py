"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafwright.llm import anchors, bpe, egojoin, htmlmain, hyperminhash, jpegcol, langid, lloyd, maskedlm, packing, prefixtrie, quality, secrets

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text by naive Bayes over character n-grams."""
    return langid.language_of_documents(_read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text by the n-gram classifier."""
    return quality.quality_of_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_egojoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings at a cosine of 0.93 within a label."""
    return egojoin.epsilon_components(_read(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmlmain.main_text(_read(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text by the backtracking encoder, and their decoding, as digests."""
    return bpe.token_digests(_read(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a progressive JPEG, read back and described."""
    return jpegcol.media_digests(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in windows of 2048 tokens, filled with lexical neighbours."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, less the false positives that the forest removes."""
    return secrets.scan(_read(spark, sf_dir, "documents"), secrets.default_forest(spark))


def op9_maskedlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every text under a network trained on all of them."""
    return maskedlm.score(_read(spark, sf_dir, "documents"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents at a Jaccard similarity of 0.85."""
    found = hyperminhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85, with_text=False)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations that were rebuilt to share beginnings."""
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.sequences(_read(spark, sf_dir, "conversations"))))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of the quantised embeddings after three rounds."""
    return lloyd.cluster_vectors(_read(spark, sf_dir, "embeddings"))


def op13_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words of runs of 35 words that start in two places."""
    return anchors.without_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), window=35, digest=True)


def queries() -> dict[str, Query]:
    return {"op1_language": op1_language, "op2_quality": op2_quality, "op3_egojoin": op3_egojoin, "op4_html": op4_html, "op5_bpe": op5_bpe, "op6_media": op6_media, "op7_packing": op7_packing, "op8_secrets": op8_secrets, "op9_maskedlm": op9_maskedlm, "op10_hyperminhash": op10_hyperminhash, "op11_prefixtrie": op11_prefixtrie, "op12_lloyd": op12_lloyd, "op13_anchors": op13_anchors}


_REACH = """reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
  least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY 1)"""

_OP3 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
  nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}, degree AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
  SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON least.id = vec_id LEFT JOIN degree ON degree.a = vec_id"""

#: For pages whose article is an ``article`` element without other containers in it, as those of the tables are.
_OP4 = r"""WITH article AS (SELECT page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*?)(?:</article>|\z)', 1) AS a FROM pages),
  cut AS (SELECT page_id, url, string_split(regexp_replace(a, '</?(?:p|h[1-6]|li|ul|ol|div)(?:\s[^>]*)?>', chr(2), 'g'), chr(2)) AS parts FROM article),
  plain AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', CASE WHEN x LIKE '%<br%' THEN ' ' ELSE '' END, 'g'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '[\s\pZ]+', ' ', 'g'))) AS parts FROM cut),
  texts AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM plain)
  SELECT page_id, url, text, length(text) AS n_chars FROM texts"""

_OP10 = rf"""WITH RECURSIVE said AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
  shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM said WHERE len(w) > 0)),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
  nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
  SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept FROM documents JOIN least ON least.id = documents.doc_id LEFT JOIN sizes ON sizes.doc_id = documents.doc_id"""


_CRC = "xor(list_reduce(range(0, 8 * length({0})), lambda a, i: xor((CASE WHEN i % 8 = 0 THEN xor(a, ascii({0}[i // 8 + 1])) ELSE a END) >> 1, CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(a, ascii({0}[i // 8 + 1])) ELSE a END) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295)"

_OP11 = f"""WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  h AS (SELECT conv_id, s, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own),
  rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.s, [])[1 : c.h], c.s[c.h + 1 :]) AS s FROM h c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
  beginnings AS (SELECT conv_id, d, s[1 : d] AS p, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
  nodes AS (SELECT d AS depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM beginnings GROUP BY 1, 2),
  children AS (SELECT p[1 : depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
  full_nodes AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(nodes.p[depth].t) END AS saved FROM nodes LEFT JOIN children ON children.p = nodes.p),
  below AS (SELECT p[1 : k] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_nodes) GROUP BY 1)
  SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
  FROM full_nodes n JOIN below b ON b.p = n.p LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[1 : n.depth - 1]"""

_DISTANCE = "list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_ROUNDS = ",\n  ".join(
    f"""near{k} AS (SELECT vec_id, q, n, c, CAST({_DISTANCE} AS BIGINT) AS distance FROM kept, centroids{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, n) = 1),
  means{k} AS (SELECT n, list(m ORDER BY i) AS c FROM (SELECT n, i, CAST(floor(sum(q[i]) / count(*)) AS BIGINT) AS m FROM (SELECT n, q, unnest(range(1, 65)) AS i FROM near{k}) GROUP BY 1, 2) GROUP BY 1),
  centroids{k + 1} AS (SELECT o.n, coalesce(m.c, o.c) AS c FROM centroids{k} o LEFT JOIN means{k} m ON m.n = o.n)"""
    for k in range(3)
)
_OP12 = f"""WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  centroids0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS n, q AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),
  {_ROUNDS},
  last AS (SELECT vec_id, n, c, CAST({_DISTANCE} AS BIGINT) AS distance FROM kept, centroids3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, n) = 1)
  SELECT vec_id, CAST(n AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last"""

_OP13 = r"""WITH said AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
  starts AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM said WHERE len(w) >= 35)),
  again AS (SELECT doc_id, i FROM starts WHERE h IN (SELECT h FROM starts GROUP BY 1 HAVING count(*) > 1)),
  words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM said),
  near AS (SELECT words.doc_id, words.i, x, max(again.i) OVER (PARTITION BY words.doc_id ORDER BY words.i) AS start FROM words LEFT JOIN again ON again.doc_id = words.doc_id AND again.i = words.i),
  left_over AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM near WHERE start IS NULL OR start <= i - 35 GROUP BY 1)
  SELECT said.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM said LEFT JOIN left_over ON left_over.doc_id = said.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are tested against brute force or held-out rows."""
    return {"op3_egojoin": _OP3, "op4_html": _OP4, "op10_hyperminhash": _OP10, "op11_prefixtrie": _OP11, "op12_lloyd": _OP12, "op13_anchors": _OP13}

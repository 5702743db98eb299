"""The registered queries of this subpackage, each over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import balltree, bpe, katz, licenses, line_dedup, mixing, phrases, quality, simhash, sketch
from tessella.llm._shared import crc32_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: documents mixed by source, weights 5, 2, 1 repeating, at most 3 epochs."""
    got = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return got.select("doc_id", "mix_.size", "mix_.source_size", "mix_.target", (F.col("mix_.size") * F.col("mix_.copies")).alias("taken"))


#: Water-filling in closed form: by cap over weight, a source is clamped as long as its share of what the sources before
#: it leave is above its cap. Then running sums in hash order.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix' || COALESCE('/' || doc_id::VARCHAR, '')) AS k,
    COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER]::BIGINT AS weight FROM s),
a AS (SELECT *, (3 * source_size)::HUGEINT AS cap FROM w WHERE source_size > 0),
b AS (SELECT *, sum(cap) OVER x - cap AS caps, sum(weight) OVER x - weight AS weights FROM a
  WINDOW x AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(source_size)::HUGEINT AS words, sum(weight)::HUGEINT AS weight FROM a),
c AS (SELECT b.*, b.cap * (t.weight - b.weights) < b.weight * (t.words - b.caps) AS clamped, t.words, t.weight AS all_weight FROM b, t),
r AS (SELECT (max(words) - COALESCE(sum(cap) FILTER (clamped), 0))::DOUBLE AS rest,
  greatest(max(all_weight) - COALESCE(sum(weight) FILTER (clamped), 0), 1)::DOUBLE AS rest_weight FROM c),
g AS (SELECT w.source, w.source_size, CASE WHEN w.source_size = 0 THEN 0::DOUBLE WHEN c.clamped THEN c.cap::DOUBLE
  ELSE w.weight::DOUBLE * r.rest / r.rest_weight END AS target
  FROM w CROSS JOIN r LEFT JOIN c ON c.source IS NOT DISTINCT FROM w.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
f AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS wanted,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS summed
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN summed - size / 2.0::DOUBLE <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken FROM f
"""


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and its edited text, and how near they and the next document are."""
    got = sketch.fingerprint(_table(spark, sf_dir, "documents"))
    return got.withColumnRenamed("id", "doc_id")


_WORDS = r"regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')".replace("\\\\", "\\")

OP4_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("COALESCE(text, '')")} AS w FROM documents),
g AS MATERIALIZED (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS t FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT t FROM g GROUP BY t HAVING count(*) > 1),
gone AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN twice USING (t)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n
  FROM (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - COALESCE(n, 0))::BIGINT AS n_removed, sha256(COALESCE(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def word_vocabulary() -> str:
    """The vocabulary file of the encoding queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.encode(_table(spark, sf_dir, "documents"), word_vocabulary()).withColumnRenamed("id", "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: every word in a window of 35 that starts elsewhere too is removed."""
    return phrases.cut(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path, license, cosine, origin of every page: its own licence, or that of the nearest directory above."""
    pages = _table(spark, sf_dir, "pages")
    files = pages.select(F.col("page_id").alias("id"), licenses.path_of(F.col("url")).alias("path"), licenses.visible(F.col("html")).alias("text"))
    return licenses.scan(files).withColumnRenamed("id", "page_id")


_BODIES = ", ".join("({}, '{}', '{}')".format(t, n, x.replace("'", "''")) for t, (n, x) in enumerate(licenses.listed(licenses.TEMPLATES)))
_T = len(licenses.listed(licenses.TEMPLATES))

OP5_SQL = rf"""
WITH f AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id,
    regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS path,
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'),
      '(?i)<(/?(p|div|li|ul|ol|tr|td|h[1-6]|article|nav|footer|header|title|section)|br)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages),
b AS (SELECT * FROM (VALUES {_BODIES}) b(t, license, body)),
tf AS (SELECT t, license, term, count(*) AS n FROM (SELECT t, license, unnest(regexp_extract_all(lower(body), '{licenses.TERM}')) AS term FROM b) GROUP BY t, license, term),
idf AS MATERIALIZED (SELECT term, ln({1 + _T}::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
tw AS MATERIALIZED (SELECT t, license, term, (1 + ln(n)) * idf AS w FROM tf JOIN idf USING (term)),
tn AS (SELECT t, sqrt(sum(w * w)) AS norm FROM tw GROUP BY t),
g AS (SELECT r, path, text, list_filter(string_split_regex(text, '{licenses.PARAGRAPHS}'), lambda x: regexp_matches(x, '{licenses.TELLS}')) AS ps FROM f WHERE regexp_matches(text, '{licenses.TELLS}')),
l AS (SELECT r, unnest(list_distinct(list_concat(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{licenses.TELLS}')), ps, [array_to_string(ps, chr(10))], CASE WHEN COALESCE(regexp_matches(path, '{licenses.LICENSE_FILE}'), false) THEN [text] ELSE [] END))) AS line FROM g),
e AS (SELECT r, line, term, count(*) AS n FROM (SELECT r, line, unnest(regexp_extract_all(lower(line), '{licenses.TERM}')) AS term FROM l) GROUP BY r, line, term),
x AS MATERIALIZED (SELECT r, line, term, (1 + ln(n)) * COALESCE(idf, 1) AS w FROM e LEFT JOIN idf USING (term)),
xn AS (SELECT r, line, sqrt(sum(w * w)) AS norm FROM x GROUP BY r, line),
c AS (SELECT r, tw.license AS license, round(sum(x.w * tw.w) / any_value(xn.norm) / any_value(tn.norm), 6) AS cosine
  FROM x JOIN xn USING (r, line) JOIN tw USING (term) JOIN tn USING (t) GROUP BY r, line, tw.t, tw.license),
o AS (SELECT r, license, cosine FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY license = '{licenses.RESERVED}', cosine DESC, license) AS k FROM c WHERE cosine >= 0.5) WHERE k = 1),
w AS (SELECT f.r, page_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, license, cosine FROM f LEFT JOIN o USING (r)),
s AS (SELECT dir, license, cosine FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY license = '{licenses.RESERVED}', cosine DESC, license) AS k
  FROM w WHERE license IS NOT NULL AND regexp_matches(path, '{licenses.LICENSE_FILE}')) WHERE k = 1),
h AS (SELECT r, arg_max(s.license, len(s.dir)) AS license, arg_max(s.cosine, len(s.dir)) AS cosine
  FROM w JOIN s ON w.dir = s.dir OR starts_with(w.dir, s.dir || '/') WHERE w.license IS NULL GROUP BY r)
SELECT page_id, path, COALESCE(w.license, h.license) AS license, COALESCE(w.cosine, h.cosine) AS cosine,
  CASE WHEN w.license IS NOT NULL THEN 'own' WHEN h.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM w LEFT JOIN h USING (r)
""".replace("\\\\", "\\")


def fitted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """The quality model of a folder: labels only of rows whose crc32(doc_id as text) mod 5 isn't 0."""
    return quality.fit(docs, _table(spark, sf_dir, "labels"), crc32_mod("doc_id", 5) != 0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = _table(spark, sf_dir, "documents")
    got = quality.score(docs, fitted_quality(spark, docs, sf_dir))
    return got.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every document, cut at the lines aligned with earlier ones."""
    got = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "lines_.n_lines", "lines_.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: shingles of 3 words, links up to 2 bits."""
    got = simhash.classes(_table(spark, sf_dir, "documents"), k=3, most=2)
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: pairs of words, trained where crc32 mod 7 isn't 2."""
    got = katz.score(_table(spark, sf_dir, "documents"), crc32_mod("doc_id", 7) == 2, stored=True)
    return got.withColumnRenamed("id", "doc_id").withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


#: crc32 of an id as text, in whole numbers.
_CRC = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, z: xor(p >> 1, CASE WHEN p & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295), 4294967295)"


def _lost(name: str, counts: str) -> str:
    """CTEs: the numbers of counts, and what a count of 1 to 5 loses."""
    n = ", ".join(f"count(*) FILTER (c = {r})" for r in range(1, 7))
    d = "((r + 1) * a[r + 1] / a[r]::DOUBLE / r - rest) / (1 - rest)"
    return f"""n{name} AS (SELECT [{n}] AS a, count(*) AS nv, sum(c)::BIGINT AS nn FROM {counts}),
l{name} AS (SELECT r, CASE WHEN a[r] > 0 AND a[r + 1] > 0 AND rest < 1 THEN CASE WHEN {d} > 0.01 AND {d} < 0.9999 THEN r * (1 - {d}) ELSE 0.5 END ELSE 0.5 END::DOUBLE AS lost
  FROM (SELECT a, CASE WHEN a[1] > 0 THEN 6 * a[6] / a[1]::DOUBLE ELSE 1 END AS rest FROM n{name}), range(1, 6) x(r))"""


OP9_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, COALESCE({_CRC} % 7 = 2, false) AS held_out,
    list_append({_WORDS.format("translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, '') AS w FROM documents),
t AS MATERIALIZED (SELECT r, held_out, w[i] AS v, CASE WHEN i = 1 THEN ' ' ELSE w[i - 1] END AS u FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS MATERIALIZED (SELECT v, count(*) AS c FROM t WHERE NOT held_out GROUP BY v),
c2 AS MATERIALIZED (SELECT u, v, count(*) AS c FROM t WHERE NOT held_out GROUP BY u, v),
{_lost("1", "c1")},
{_lost("2", "c2")},
p1 AS MATERIALIZED (SELECT v, c, (c - COALESCE(lost, 0.01)) / nn AS p, COALESCE(lost, 0.01) / nn AS gone FROM c1 LEFT JOIN l1 ON c = r, n1),
k AS (SELECT sum(gone) AS unknown FROM p1),
s AS MATERIALIZED (SELECT u, sum(c2.c) AS cu, sum(COALESCE(lost, 0.01)) / sum(c2.c) / (1 - sum(p)) AS alpha FROM c2 LEFT JOIN l2 ON c = r JOIN p1 USING (v) GROUP BY u),
q AS (SELECT t.r, p1.c IS NOT NULL AS known, log10((COALESCE(p1.c, 0) + 1) / (n1.nn + n1.nv + 1)::DOUBLE) AS base,
    log10(CASE WHEN c2.c IS NOT NULL THEN (c2.c - COALESCE(lost, 0.01)) / cu ELSE COALESCE(alpha, 1) * COALESCE(p, unknown) END) AS score
  FROM t LEFT JOIN p1 USING (v) LEFT JOIN c2 ON t.u = c2.u AND t.v = c2.v LEFT JOIN l2 ON c2.c = l2.r LEFT JOIN s ON t.u = s.u, n1, k)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, any_value(n1.nn) AS train_tokens, round(sum(base), 6) AS base_score, round(sum(score), 6) AS score
FROM d JOIN q USING (r), n1 GROUP BY r, doc_id, held_out
"""


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 largest integer inner products of each row with vec_id % 50 = 0."""
    vectors = balltree.whole_vectors(_table(spark, sf_dir, "embeddings"))
    return balltree.top_k(vectors, F.pmod("id", F.lit(50)) == 0, 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_bpe_encoding": op3_bpe_encoding,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_katz_scoring": op9_katz_scoring,
    "op10_exact_top_k": op10_exact_top_k,
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_license_scan": OP5_SQL,
    "op9_katz_scoring": OP9_SQL,
    "op10_exact_top_k": OP10_SQL}

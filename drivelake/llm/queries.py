"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, filter_audit, jaccard, langid, line_dedup, lm, mixing, packing, phrases, pieces, pii, quality
from .common import read

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.score_held_out(read(spark, d, "documents"), read(spark, d, "labels"))


def op2_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, d, "documents"))


def op3_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, d, "embeddings"))


def op4_lm(spark: SparkSession, d: str) -> DataFrame:
    return lm.score_held_out(read(spark, d, "documents"))


def op5_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.jaccard_groups(read(spark, d, "documents"))


def op6_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(read(spark, d, "documents"))


def op7_pii(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return pii.digested(pii.find_pii(docs, pii.fit(docs)))


def op8_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_words", "words_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), tokenizer_path())


def op10_langid(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify_held_out(read(spark, d, "documents"))


def op11_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.digested(pieces.encode_texts(read(spark, d, "documents"), tokenizer_path(PIECES)))


def op12_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, d, "documents"), read(spark, d, "labels"))


def op13_phrases(spark: SparkSession, d: str) -> DataFrame:
    return phrases.collocations(read(spark, d, "documents"))


NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

EXACT_SQL = f"""
WITH t AS (SELECT doc_id, {NORMAL} AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

# The links of op3 and op5 as pairs a < b, their components as the least id that a chain of links reaches.
REACH = """
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"""

VECTORS_SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
{REACH},
degree AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(l.m, e.vec_id) AS component_id, coalesce(l.m, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM x JOIN x y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
{REACH}
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.m, s.doc_id) AS component_id FROM s LEFT JOIN least l ON l.a = s.doc_id
"""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(sha256('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, source_size * 2.0::DOUBLE AS cap, ([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1])::DOUBLE AS w FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS own_level
  FROM weighed WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, max(own_level) OVER () * w) AS target FROM levels),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
budgets AS (
  SELECT p.doc_id, p.source, p.size, t.source_size, t.target, p.before, CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS epochs
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken FROM budgets
"""

AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
m AS (SELECT part,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM w),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a JOIN f b ON a.b & b.b = 0 JOIN f c ON (a.b | b.b) & c.b = 0 JOIN f d ON (a.b | b.b | c.b) & d.b = 0 JOIN f e ON (a.b | b.b | c.b | d.b) & e.b = 0),
s AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS seen FROM o, (SELECT unnest(range(1, 6)) AS step) k),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (seen | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & seen = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & seen <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (mask & seen = 0 AND mask & bit <> 0 AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (mask & seen = 0 AND mask & bit <> 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

PHRASES_SQL = r"""
WITH p AS (SELECT doc_id, lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM x),
total AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f1 AS (SELECT lang, x, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*) AS a FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(a) AS most FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) u GROUP BY ALL),
two AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, l.f AS l, r.f AS r FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y
  LEFT JOIN longer m ON m.lang = f2.lang AND m.x = f2.x AND m.y = f2.y WHERE f2.f >= 10 AND (m.most IS NULL OR 100 * m.most < 50 * f2.f)),
cuts AS (SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, a, 1 AS k, l.f AS l, r.f AS r FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.x = f3.x JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, a, 2, l.f, r.f FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 r ON r.lang = f3.lang AND r.x = f3.z
  UNION ALL SELECT lang, phrase, a, 1, l, r FROM two),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
one AS (SELECT lang, phrase, a, arg_min(l, score * 10 + k) AS l, arg_min(r, score * 10 + k) AS r, min(score) AS score FROM scored GROUP BY lang, phrase, a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

QUERIES = {f.__name__: f for f in (op1_quality, op2_exact_dedup, op3_embeddings, op4_lm, op5_jaccard, op6_mixing, op7_pii, op8_line_dedup, op9_packing, op10_langid, op11_pieces, op12_filter_audit, op13_phrases)}
SQL = {"op2_exact_dedup": EXACT_SQL, "op3_embeddings": VECTORS_SQL, "op5_jaccard": JACCARD_SQL, "op6_mixing": MIXING_SQL, "op12_filter_audit": AUDIT_SQL, "op13_phrases": PHRASES_SQL}

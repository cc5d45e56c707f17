"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fill_middle, fingerprints, language_id, line_dedup, minhash_dedup, mixing, nearest, phrases, pii, quality, toxicity
from .common import read


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(read(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(read(spark, sf_dir, "documents")).select("doc_id", "text", F.col("pii_entities").alias("n_entities"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduped(read(spark, sf_dir, "documents")).select("doc_id", "text", F.col("line_dedup_lines").alias("n_lines"), F.col("line_dedup_gone").alias("n_dropped"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(read(spark, sf_dir, "documents"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.checked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_nearest_neighbours": _op1,
    "op2_minhash_near_dedup": _op2,
    "op3_mixing_to_target_weights": _op3,
    "op4_bpe_encode_decode": _op4,
    "op5_pii_surrogates": _op5,
    "op6_document_fingerprints": _op6,
    "op7_line_dedup": _op7,
    "op8_toxicity": _op8,
    "op9_quality": _op9,
    "op10_language_id": _op10,
    "op11_phrase_collocations": _op11,
    "op12_fill_in_middle": _op12,
    "op13_decontamination": _op13,
}

#: Water filling, written independently: sources sorted by cap per weight, capped ones first.
_OP3 = r"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sizes GROUP BY source),
levels AS (SELECT *, (1.5 * sum(s) OVER () - coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
wanted AS (SELECT source, s, CASE WHEN 2 * s / w > level THEN w * max(CASE WHEN 2 * s / w > level THEN level END) OVER () ELSE 2 * s END AS target FROM levels),
rated AS (SELECT d.doc_id, d.size, s, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate,
                 CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
          FROM sizes d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""

#: Every window of every text against every window of every item, without fingerprints.
_OP13 = r"""
WITH ours AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
known AS (SELECT DISTINCT item_id, least(len(w), 10) AS span, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
          FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
spans AS (SELECT DISTINCT span FROM known),
places AS (SELECT doc_id, a, span, array_to_string(w[a:a + span - 1], ' ') AS win
           FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS a FROM ours, spans WHERE len(w) >= span)),
found AS (SELECT doc_id, a, p.span, item_id FROM places p JOIN known k ON p.span = k.span AND p.win = k.win),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + span)) AS pos FROM found) GROUP BY doc_id),
lists AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT o.doc_id, CAST(len(o.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM ours o LEFT JOIN hits h ON o.doc_id = h.doc_id LEFT JOIN lists l ON o.doc_id = l.doc_id
"""

_OP11 = r"""
WITH pieces AS (SELECT lang, doc_id, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
                FROM (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (SELECT lang, 1 AS k, w[i] AS phrase FROM runs UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM runs WHERE i < len(w)
          UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM runs WHERE i + 1 < len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT *, array_to_string(w[:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (SELECT c.lang, c.k, c.phrase, c.a, c.w, c.c, p.f AS l, q.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(p.f AS HUGEINT) * q.f) AS BIGINT) AS score
           FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = c.x JOIN f q ON q.lang = c.lang AND q.phrase = c.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
around AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, array_to_string(w[:2], ' ') AS phrase, a FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""

_OP12 = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM base),
cut AS (SELECT *, array_to_string(w[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
               array_to_string(w[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
               array_to_string(w[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS s,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""

ORACLES = {"op11_phrase_collocations": _OP11, "op12_fill_in_middle": _OP12, "op3_mixing_to_target_weights": _OP3, "op13_decontamination": _OP13}

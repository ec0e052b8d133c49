"""The corpus operators as queries over the given tables, with production parameters."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import (
    common,
    cross_tokens,
    decontamination,
    html_extract,
    jaccard_join,
    language_id,
    quality_lm,
    quality_rules,
    rank_bpe,
    sentencepiece_bpe,
    substring_dedup,
    token_counts,
    token_files,
    vector_codes,
)

END_ID = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    token_files.write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.checksum(token_files.read(spark, path))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("text_hash")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(documents(spark, sf_dir)).drop("row")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_lm.classify(documents(spark, sf_dir), labels.filter("quality = 1").select("doc_id"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(documents(spark, sf_dir))


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def shipped(query):
    """The query, after the executors have this package."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = (op1_language_id, op2_token_files, op3_decontamination, op4_html_extract, op5_substring_dedup, op6_jaccard_join, op7_quality_lm, op8_sentencepiece, op9_token_counts, op10_quality_rules, op11_cross_tokens, op12_rank_bpe, op13_vector_codes)
    return {f.__name__: shipped(f) for f in found}


#: Runs of word characters after lower-casing A-Z, as the contract of decontamination has them.
WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + 12], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM wins),
hits AS (SELECT d.r, t.i, s.size, array_to_string(d.w[t.i:t.i + s.size - 1], ' ') AS win
  FROM d, sizes s, unnest(range(1, len(d.w) - s.size + 2)) AS t(i)
  WHERE len(d.w) >= s.size),
found AS (SELECT h.r, h.i, h.size, x.item_id FROM hits h JOIN wins x ON h.win = x.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + size)) AS t(p) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM found GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS sh FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach ON reach.a = d.r JOIN d e ON e.r = reach.b GROUP BY d.r, d.doc_id, n.n
"""


def lloyd_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Vector codes by comparing every part with every entry, one pair of tables a round."""
    ties = """SELECT p.r, p.p, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, k := b.k)) AS m
  FROM cut p JOIN b{0} b ON p.p = b.p GROUP BY 1, 2"""
    mean = """SELECT p, k, list(v ORDER BY i) AS x FROM (SELECT a.p, a.m.k AS k, t.i, floor(sum(c.x[t.i])::DOUBLE / count(*))::BIGINT AS v
  FROM a{0} a JOIN cut c USING (r, p), unnest(range(1, len(c.x) + 1)) AS t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2
  UNION ALL SELECT b.p, b.k, b.x FROM b{0} b WHERE NOT EXISTS (SELECT 1 FROM a{0} a WHERE a.p = b.p AND a.m.k = b.k)"""
    steps = "".join(f"a{i} AS MATERIALIZED ({ties.format(i)}), b{i + 1} AS MATERIALIZED ({mean.format(i)}), " for i in range(rounds))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, unnest(range({parts})) AS t(p)),
b0 AS (SELECT p, r - 1 AS k, x FROM cut WHERE r <= {entries}), {steps}
a{rounds} AS MATERIALIZED ({ties.format(rounds)}),
coded AS (SELECT r, string_agg(lower(printf('%02x', m.k)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, k, i)) AS d FROM (SELECT p, k, unnest(x) AS v, unnest(range(len(x))) AS i FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT d FROM digest) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op6_jaccard_join": OP6_SQL, "op13_vector_codes": lloyd_sql()}

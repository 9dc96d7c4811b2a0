"""The registered queries opN_* and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_sharding, op2_search, op3_language, op4_pii, op5_licenses, op6_decontaminate, op7_html, op8_jaccard, op9_packing, op10_repeats, op11_lines, op12_whitening, op13_ranking
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    out = op1_sharding.shard_documents(documents(spark, sf_dir), 16)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of every hundredth vector against all vectors."""
    rows = documents(spark, sf_dir, "embeddings")
    return op2_search.top_k(rows, rows.filter("vec_id % 100 = 0"), 10)


SQL["op2_segment_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op9_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return op9_packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048)


@query
def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    return op3_language.predict_languages(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    items = documents(spark, sf_dir, "benchmark")
    found = op6_decontaminate.find_passages(documents(spark, sf_dir), items, ["doc_id"])
    counted = found.withColumn("n_hit", op6_decontaminate.hit_words())
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        op6_decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


WORDS_SQL = r"""regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL["op6_fm_decontaminate"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format(text="text")} AS w FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, {WORDS_SQL.format(text="text")} AS w FROM benchmark
), sized AS (
  SELECT item, w, least(13, len(w)) AS k FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, k, list_slice(w, i, i + k - 1) AS v
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), places AS (
  SELECT r, k, i, list_slice(w, i, i + k - 1) AS v
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
  SELECT p.r, p.i, p.k, x.item FROM places p JOIN windows x ON p.k = x.k AND p.v = x.v
), words_hit AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r
), items_hit AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)
"""


@query
def op5_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and wordings in every whole text."""
    return op5_licenses.scan_licenses(documents(spark, sf_dir), ["doc_id"])


_TEMPLATE_ROWS = ", ".join(
    f"({n}, '{label}', {base}, {place}, {grams}, {k}, '{gram}')"
    for n, label, base, place, grams, k, gram in op5_licenses.templates()
)
SQL["op5_diagonal_licenses"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format(text="text")} AS w FROM documents
), t(template, label, base, place, grams, k, gram) AS (VALUES {_TEMPLATE_ROWS}
), places AS (
  SELECT r, i - 1 AS pos, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (VALUES (2), (3)) AS s(k) WHERE len(w) >= k)
), votes AS (
  SELECT DISTINCT r, template, label, base, grams, pos - place AS diagonal, place
  FROM places JOIN t USING (k, gram)
), diagonals AS (
  SELECT r, template, label, base, grams, diagonal, list(place) AS places FROM votes GROUP BY ALL
), cut AS (
  SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER near, {op5_licenses.GAP + 1}) > {op5_licenses.GAP} THEN 1 ELSE 0 END AS fresh
  FROM diagonals WINDOW near AS (PARTITION BY r, template ORDER BY diagonal)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM cut
), spans AS (
  SELECT r, template, label, base, min(diagonal) AS start,
    len(list_distinct(flatten(list(places)))) / any_value(grams) AS coverage
  FROM numbered GROUP BY r, template, label, base, span
), kept AS (
  SELECT * FROM spans WHERE NOT base OR coverage = 1
), found AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR coverage >= {op5_licenses.SHARE}) AS labels,
    max(coverage) AS score
  FROM kept GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN found USING (r)
"""


@query
def op7_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return op7_html.extract(documents(spark, sf_dir, "pages"), ["page_id", "url"])


#: A test key; a user passes a secret one.
PSEUDONYM_KEY = "registered-query"


@query
def op4_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced by pseudonyms."""
    out = op4_pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_KEY)
    kinds = F.array_join(F.transform("pii", lambda x: x["kind"]), ",")
    return out.select("doc_id", "text", F.size("pii").alias("n_values"), kinds.alias("kinds"))


@query
def op8_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document among texts of five-word shingles alike by 0.8 or more."""
    return op8_jaccard.similar_texts(documents(spark, sf_dir)).select(
        "doc_id", "class_id", "n_links", "n_text_links", "n_words"
    )


@query
def op10_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in passages of 50 words or more that other documents have, too."""
    found = op10_repeats.repeated_passages(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_words",
        op6_decontaminate.hit_words().alias("n_repeated"),
        F.size("spans").cast("long").alias("n_spans"),
        F.transform("spans", lambda s: s["start"]).alias("starts"),
        F.transform("spans", lambda s: s["end"]).alias("ends"),
    )


@query
def op11_common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that three documents or more have, but for the last of them."""
    out = op11_lines.drop_common_lines(documents(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op11_common_lines"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775807 - 1) AS id,
    string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), l AS (
  SELECT r, id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs)
), common AS (
  SELECT key, max(id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT id) >= 3
), marked AS (
  SELECT r, i, line, coalesce(l.id <> common.keeper, false) AS gone FROM l LEFT JOIN common ON l.key = common.key
), joined AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM docs JOIN joined USING (r)
"""


@query
def op12_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 8 principal components of all vectors, whitened."""
    rows = documents(spark, sf_dir, "embeddings")
    return op12_whitening.whiten(rows, op12_whitening.fit_whitening(rows))


@query
def op13_shared_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item."""
    return op13_ranking.rank_documents(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


SQL["op13_shared_ranking"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format(text="text")} AS w FROM documents
), sized AS (
  SELECT r, doc_id, w, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized
), found AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM sized) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
  FROM found, total GROUP BY term
), items AS (
  SELECT DISTINCT item_id, unnest({WORDS_SQL.format(text="text")}) AS term FROM benchmark
), scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM items JOIN found USING (term) JOIN weights USING (term) JOIN sized USING (r), total GROUP BY item_id, r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

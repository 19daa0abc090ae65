"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import block_naming, byte_pairs, collision_search, jaccard_join, language_id, lexical_search, quality_classifier, quality_rules, repeated_passages, source_mix, threshold_mining, token_files, warc_derivatives
from tallyflow.llm.common import read, remainder
from tallyflow.session import stage_path, staged


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = language_id.train(docs, remainder("doc_id", 4) != 2)
    return language_id.predict(docs, net).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives.derive(warc_derivatives.responses(read(spark, sf_dir, "pages"))).drop("record")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.remove_repeats(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-files")
    token_files.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_back(spark, path)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.find_copies(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(quality_classifier.statistics(read(spark, sf_dir, "documents")), "quality-stats")
    model = quality_classifier.train(stats, read(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return quality_classifier.score(stats, model).select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_pairs.round_trip(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collision_search.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
    return found.select("query_id", "rank", "vec_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 10)
    return found.select("item_id", "rank", "doc_id", "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = threshold_mining.mine(read(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules count, and the base verdict, without the part that is estimated."""
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )


def source_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of the mix, without what is drawn."""
    return op10_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_quality_rules": op3_quality_rules,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_files": op6_token_files,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_source_mix": op10_source_mix,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
    "quality_rule_counts": quality_rule_counts,
    "source_mix_targets": source_mix_targets,
}

SQL: dict[str, str] = {
    "op7_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY body)""",
    "op4_substring_dedup": """
        WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
        windows AS (
            SELECT doc_id, start, row_number() OVER (PARTITION BY passage ORDER BY doc_id, start) AS nth
            FROM (SELECT doc_id, start, array_to_string(words[start : start + 19], ' ') AS passage
                  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM t WHERE len(words) >= 20) AS s) AS p),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM windows WHERE nth > 1),
        placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM t),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS body
            FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(body, '')) AS kept_sha256
        FROM t LEFT JOIN kept USING (doc_id)""",
    "op5_ngram_jaccard_join": """
        WITH RECURSIVE t AS (
            SELECT doc_id, coalesce(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS words
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(words[start : start + 4], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS start FROM t WHERE len(words) > 0) AS s),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
            FROM shingles AS a JOIN shingles AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM shared JOIN sizes AS a ON x = a.doc_id JOIN sizes AS b ON y = b.doc_id
            WHERE 100 * common >= 75 * (a.n + b.n - common)),
        near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reached AS (
            SELECT doc_id, doc_id AS other FROM t
            UNION SELECT r.doc_id, y FROM reached AS r JOIN near ON other = x)
        SELECT t.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
        FROM t JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY t.doc_id""",
    "quality_rule_counts": """
        WITH t AS (SELECT doc_id, text, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents),
        lines AS (
            SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS found
            FROM documents),
        triples AS (
            SELECT doc_id, start, count(*) OVER (PARTITION BY doc_id, triple) AS times
            FROM (SELECT doc_id, start, words[start : start + 2] AS triple
                  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS start FROM t WHERE len(words) >= 3) AS s) AS p),
        repeats AS (
            SELECT doc_id, count(DISTINCT place) AS n FROM (
                SELECT doc_id, unnest(range(start, start + 3)) AS place FROM triples WHERE times > 1) AS c GROUP BY 1),
        counts AS (
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
                   length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                   CAST(len(found) - len(list_distinct(found)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
            FROM t JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts""",
    "source_mix_targets": """
        WITH sizes AS (
            SELECT doc_id, source, coalesce(CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT), 0) AS size FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * sum(size) AS cap,
                   1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
            FROM sizes GROUP BY source),
        levels AS (
            SELECT cap / weight AS ratio,
                   (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM sources
            WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        final AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio > level)
        SELECT doc_id, size, source_size, round(least(cap, coalesce(level * weight, cap)), 4) AS target
        FROM sizes JOIN sources ON sizes.source IS NOT DISTINCT FROM sources.source CROSS JOIN final""",
    "op12_lexical_search": """
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
            FROM documents),
        counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
        sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
        corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
        lengths AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // total AS m FROM sizes, corpus),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counts, corpus GROUP BY term, docs),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
            FROM benchmark),
        scores AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY 1, 2)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 10""",
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS units
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
                   CAST(list_inner_product(a.units, v.units) AS BIGINT) AS score
            FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
}

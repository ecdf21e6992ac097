"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(documents(spark, sf_dir), width=3, similarity=(90, 100))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(documents(spark, sf_dir))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(documents(spark, sf_dir), min_docs=10, keep_first=False)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import default_tokenizer, pack

    return pack(documents(spark, sf_dir), default_tokenizer(), length=1024, end_id=2)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mixing import mixing_report

    return mixing_report(documents(spark, sf_dir), entropy_share=0.5, most_repetition=2.0)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(documents(spark, sf_dir)).drop("shard", "offset", "length")  # places differ from run to run


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_report

    return quality_report(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_report

    return language_report(documents(spark, sf_dir))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_report

    return cluster_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, seed=3, scale=1024)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_report

    return substring_report(documents(spark, sf_dir), width=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_lm_score, op3_html_text, op4_line_dedup, op5_best_fit_packing, op6_pii, op7_source_mixing, op8_media_columns, op9_quality_rules, op10_language_id, op11_centroid_clustering, op12_filter_audit, op13_substring_dedup, pipeline)}


ASCII_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _kmeans_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds over a row a vector and component."""
    parts = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "comp AS MATERIALIZED (SELECT rid, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS x FROM kept)",
        f"pick AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM pick JOIN comp USING (rid))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT rid, c, sum((comp.x - c{n}.x) * (comp.x - c{n}.x))::HUGEINT AS d FROM comp JOIN c{n} USING (i) GROUP BY rid, c)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT rid, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n} JOIN comp USING (rid) GROUP BY c, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x)::BIGINT AS x FROM c{n} LEFT JOIN m{n} USING (c, i))")
    last = rounds
    return f"""
        WITH {", ".join(parts)},
        digest AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{last} GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
        FROM a{last} JOIN kept USING (rid) JOIN digest USING (c)"""


def oracle_sql() -> dict[str, str]:
    key = LOWER_AZ.format(f"trim(line, {ASCII_SPACE})")
    word = f"unnest(list_filter(regexp_split_to_array({LOWER_AZ.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))"
    words = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    mask = " + ".join(f"(CASE WHEN {c} THEN {1 << k} ELSE 0 END)" for k, c in enumerate(["len(w) < 50", "100 * len(list_distinct(w)) < 65 * len(w)", "100 * capitals > 5 * length(t)", "regexp_matches(t, '[#$%&*|]')", "first < doc_id"]))
    return {
        "op11_centroid_clustering": _kmeans_sql(),
        "op12_filter_audit": f"""
            WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {words} AS w, len(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
            m AS (SELECT doc_id, part, {mask} AS mask FROM d),
            l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
            n AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
            letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a, unnest([1, 2, 4, 8, 16]) AS bit),
            walk AS (SELECT '' AS o, 0 AS used, 0 AS before, 0 AS bit UNION ALL SELECT o || a, used | letter.bit, used, letter.bit FROM walk JOIN letter ON used & letter.bit = 0),
            step AS (SELECT f.o AS filter_order, len(p.o)::INTEGER AS step, p.bit, p.before FROM walk f JOIN walk p ON f.used = 31 AND p.o <> '' AND starts_with(f.o, p.o))
            SELECT part, filter_order, step,
                   coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
                   (sum(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
            FROM n CROSS JOIN step GROUP BY part, filter_order, step, bit""",
        "op13_substring_dedup": f"""
            WITH t AS (SELECT doc_id, {words} AS w FROM documents),
            win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: sha256(array_to_string(w[i:i + 49], ' ')))) AS s FROM t WHERE len(w) >= 50),
            hit AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win),
            gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(range(50)) AS k) WHERE first < doc_id),
            word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
            kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS rest FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
            SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)""",
        "op1_ngram_jaccard_join": f"""
            WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER_AZ.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
            shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
            size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
            common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
            link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
            edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
            reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.r)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) LEFT JOIN size USING (doc_id)""",
        "op2_lm_score": f"""
            WITH word AS (SELECT doc_id, {word} AS w, generate_subscripts(list_filter(regexp_split_to_array({LOWER_AZ.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), 1) AS pos FROM documents),
            mark AS (SELECT doc_id, '' AS w, 0 AS pos FROM word WHERE pos = 1),
            gram AS (SELECT doc_id, pos, w, lag(w) OVER d AS u, lag(w, 2) OVER d AS t FROM (FROM word UNION ALL FROM mark) WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
            c1 AS (SELECT w, count(*) AS c FROM gram GROUP BY w),
            c2 AS (SELECT u, w, count(*) AS c FROM gram WHERE pos >= 1 GROUP BY u, w),
            c3 AS (SELECT t, u, w, count(*) AS c FROM gram WHERE pos >= 2 GROUP BY t, u, w),
            total AS (SELECT count(*) AS n FROM word),
            s AS (SELECT g.doc_id, g.pos, c3.c AS three, ctx.c AS context, CASE WHEN c2.c >= 2 THEN c2.c / cu.c ELSE 0.4 * cw.c / (SELECT n FROM total) END AS two
                  FROM gram g JOIN c2 ON c2.u = g.u AND c2.w = g.w JOIN c1 cu ON cu.w = g.u JOIN c1 cw ON cw.w = g.w
                  LEFT JOIN c3 ON c3.t = g.t AND c3.u = g.u AND c3.w = g.w LEFT JOIN c2 ctx ON ctx.u = g.t AND ctx.w = g.u),
            p AS (SELECT doc_id, ln(CASE WHEN pos = 1 THEN two WHEN three >= 2 THEN three / context ELSE 0.4::DOUBLE * two END) AS lp FROM s)
            SELECT d.doc_id, count(lp) AS n_tokens, round(coalesce(sum(lp), 0), 4) AS logprob, round(sum(lp) / nullif(count(lp), 0), 6) AS score
            FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id""",
        "op4_line_dedup": f"""
            WITH lines AS (
                SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
                FROM documents),
            keyed AS (SELECT *, {key} AS k FROM lines),
            dropped AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
            SELECT doc_id, count(*) AS n_lines, count(d.k) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE d.k IS NULL), '')) AS kept_sha256
            FROM keyed LEFT JOIN dropped d USING (k) GROUP BY doc_id""",
    }

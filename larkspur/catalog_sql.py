"""DuckDB SQL with the same result as the queries of the catalogue, where SQL can say it.

Left out: vectors of hashed words (sentence_faithfulness), a stemmer
(qa_rouge_l_stemmed), per-row text machinery (answer_cleanup, rewrite_cleanup),
the unrolled state machine (retry_unrolled, agentic_rates, linear_answers),
times (timed_answers) and approximate search (dense_ann_recall); tests compare
these with plain versions.
"""

from __future__ import annotations

import math

WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda t: t <> '')"
TOKENS = WORDS.format("lower({})")
PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~"
ANSWER = "list_filter(string_split_regex(translate(lower({}), '" + PUNCTUATION + "', ''), '\\s+'), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))"
LONG_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{4,}}'))"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"

TURNS = """
turns AS (
    SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS truth, a.text AS prediction
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant')"""

LCS = """
ab AS (SELECT pair_id, list_filter(string_split_regex(lower(prediction), '[^a-z0-9]+'), lambda t: t <> '') AS a,
              list_filter(string_split_regex(lower(truth), '[^a-z0-9]+'), lambda t: t <> '') AS b FROM turns),
lcs AS (
    SELECT pair_id, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS r FROM ab
    UNION ALL
    SELECT pair_id, i + 1, list_transform(range(len(c)), lambda j: list_max(c[1:j + 1])) FROM (
        SELECT l.pair_id, l.i, list_concat([0], list_transform(range(1, len(b) + 1), lambda j: greatest(r[j + 1], r[j] + (b[j] = a[l.i + 1])::INT))) AS c
        FROM lcs l JOIN ab USING (pair_id) WHERE l.i < len(a))),
rouge AS (
    SELECT pair_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0::DOUBLE * list_max(r) / (len(a) + len(b)) END AS rouge_l
    FROM lcs JOIN ab USING (pair_id) WHERE i = len(a))"""

F1 = f"""
tok AS (SELECT pair_id, {ANSWER.format("prediction")} AS a, {ANSWER.format("truth")} AS b FROM turns),
ca AS (SELECT pair_id, t, count(*) AS n FROM (SELECT pair_id, unnest(a) AS t FROM tok) GROUP BY ALL),
cb AS (SELECT pair_id, t, count(*) AS n FROM (SELECT pair_id, unnest(b) AS t FROM tok) GROUP BY ALL),
common AS (SELECT ca.pair_id, sum(least(ca.n, cb.n)) AS n FROM ca JOIN cb USING (pair_id, t) GROUP BY 1),
f1 AS (SELECT pair_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0::DOUBLE * coalesce(n, 0) / (len(a) + len(b)) END AS f1,
              (list_aggregate(a, 'string_agg', ' ') IS NOT DISTINCT FROM list_aggregate(b, 'string_agg', ' '))::INT::DOUBLE AS exact_match
       FROM tok LEFT JOIN common USING (pair_id))"""

OVERLAP = "len(list_intersect({0}, {1}))::DOUBLE / greatest(len({0}), 1)"
_P, _T = LONG_WORDS.format("prediction"), LONG_WORDS.format("truth")
RESULTS = f"""{TURNS},{F1},{LCS},
results AS (
    SELECT pair_id, truth, prediction, exact_match, round(f1, 9) AS f1, round(rouge_l, 9) AS rouge_l, round({OVERLAP.format(_P, _T)}, 9) AS faithfulness, round({OVERLAP.format(_T, _P)}, 9) AS reversed
    FROM turns JOIN f1 USING (pair_id) JOIN rouge USING (pair_id))"""

AGGREGATE = f"""{RESULTS},
metrics AS (
    SELECT config, metric, value FROM (
        SELECT 'direct' AS config, f1, exact_match, rouge_l, faithfulness FROM results
        UNION ALL SELECT 'reversed', f1, exact_match, rouge_l, reversed FROM results)
    UNPIVOT (value FOR metric IN (f1, exact_match, rouge_l, faithfulness))),
agg AS (SELECT config, metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
               round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM metrics GROUP BY ALL)"""

CATEGORISED = f"""{RESULTS},
flags AS (
    SELECT *, truth <> '' AND NOT contains(lower(truth), lower(truth)) AS missed, faithfulness < 0.5 AND f1 > 0 AS made_up, faithfulness < 0.5 AS unfaithful,
           len({WORDS.format("prediction")}) < 3 AND f1 < 0.3 AS short FROM results),
named AS (
    SELECT *, list_filter([
        CASE WHEN missed THEN 'retrieval_failure' END, CASE WHEN made_up THEN 'hallucination' END, CASE WHEN unfaithful AND NOT missed AND NOT made_up THEN 'low_context_relevance' END,
        CASE WHEN short THEN 'incomplete_answer' END, CASE WHEN rouge_l > 0.4 AND exact_match = 0 AND f1 < 0.5 THEN 'verbose_answer' END,
        CASE WHEN f1 < 0.3 AND exact_match = 0 AND NOT made_up AND NOT short THEN 'wrong_answer' END], lambda x: x IS NOT NULL) AS found FROM flags),
categorised AS (
    SELECT *, CASE WHEN exact_match = 1 OR f1 >= 0.8 THEN ['correct'] WHEN trim(prediction) = '' THEN ['empty_response'] WHEN len(found) = 0 THEN ['wrong_answer'] ELSE found END AS categories FROM named)"""


def bm25(queries: str, k: int, name: str = "bm25") -> str:
    """CTEs up to `name` (query_id, rank, doc_id, score) for a relation of (query_id, query)."""
    return f"""
dtok AS (SELECT doc_id, {TOKENS.format("text")} AS toks FROM documents),
dl AS (SELECT doc_id, len(toks) AS dl FROM dtok),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM dtok) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qterm AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format("query")}) AS term FROM {queries}) GROUP BY ALL),
scored AS (
    SELECT query_id, doc_id, sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))) AS score
    FROM qterm JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM scored) WHERE rank <= {k})"""


PASSAGES = "passages AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
GOLD = "containing AS (SELECT query_id, doc_id FROM passages JOIN documents ON contains(text, query)), gold AS (SELECT query_id, min(doc_id) AS doc_id FROM containing GROUP BY 1)"


def dense(queries: str, k: int, name: str = "dense", score: str = DOT.format("q.embedding", "e.embedding"), order: str = "DESC") -> str:
    return f"""
{name} AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) {order}, doc_id)::INT AS rank
    FROM (SELECT q.query_id, e.vec_id AS doc_id, {score} AS score FROM {queries} q CROSS JOIN embeddings e)) WHERE rank <= {k})"""


VECTOR_QUERIES = "vq AS (SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0)"
PASSAGE_VECTORS = "pv AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark))"
L2 = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))"


def fused(k: int, weights: str = "0.5::DOUBLE, 0.5::DOUBLE", name: str = "hybrid") -> str:
    wd, ws = weights.split(",")
    return f"""
sides AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS dense_rank, b.rank AS sparse_rank
          FROM dense a FULL OUTER JOIN bm25 b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST)::INT AS rank
    FROM (SELECT *, coalesce({wd} / (60 + dense_rank), 0) + coalesce({ws} / (60 + sparse_rank), 0) AS rrf_score FROM sides)) WHERE rank <= {k})"""


RETRIEVAL = f"{PASSAGES},{GOLD},{PASSAGE_VECTORS},{dense('pv', 20)},{bm25('passages', 20)}"
RERANKED = f"""
scored2 AS (
    SELECT h.query_id, h.doc_id, h.rank AS prior_rank,
           round(12.0::DOUBLE * len(list_intersect(list_distinct({TOKENS.format("p.query")}), {TOKENS.format("d.text")})) / greatest(len(list_distinct({TOKENS.format("p.query")})), 1) - 6.0, 9) AS rerank_score
    FROM bm25 h JOIN passages p USING (query_id) JOIN documents d USING (doc_id)),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, prior_rank)::INT AS rank FROM scored2) WHERE rank <= 5)"""


def windows(size: int, stride: int, to_the_end: bool) -> str:
    stop = f"AND (pos = 0 OR pos - {stride} + {size} < n)" if to_the_end else ""
    return f"""
    SELECT doc_id, (pos // {stride})::INT AS chunk_index, trunc(pos / n * chars)::INT AS start_char, trunc(least(pos + {size}, n) / n * chars)::INT AS end_char,
           (least(pos + {size}, n) - pos)::INT AS n_tokens, array_to_string(toks[pos + 1:pos + {size}], ' ') AS content
    FROM (SELECT doc_id, toks, len(toks) AS n, length(text) AS chars, unnest(range(0, len(toks), {stride})) AS pos FROM (SELECT doc_id, text, {WORDS.format("text")} AS toks FROM documents)) WHERE n > 0 {stop}"""


STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
def semantic(target: int, most: int) -> str:
    """CTEs up to `semantic`: sentences of up to target tokens together; one of over most is cut."""
    return f"""
paragraph AS (SELECT doc_id, {STRIPPED.format("unnest(ps)")} AS p, generate_subscripts(ps, 1) AS pi FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents)),
split AS (SELECT doc_id, pi, string_split(regexp_replace(p, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss FROM paragraph WHERE p <> ''),
sentence AS (SELECT doc_id, s, len({WORDS.format("s")}) AS n, length(s) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) AS i
             FROM (SELECT doc_id, pi, {STRIPPED.format("unnest(ss)")} AS s, generate_subscripts(ss, 1) AS si FROM split) WHERE s <> ''),
fold AS (SELECT doc_id, i, 1 AS gid, CASE WHEN n > {most} THEN 0 ELSE n END AS total, n > {most} AS forced FROM sentence WHERE i = 1
         UNION ALL SELECT s.doc_id, s.i, f.gid + (s.n > {most} OR f.forced OR f.total + s.n > {target})::INT, CASE WHEN s.n > {most} THEN 0 WHEN f.forced OR f.total + s.n > {target} THEN s.n ELSE f.total + s.n END, s.n > {most}
         FROM fold f JOIN sentence s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
grouped AS (SELECT doc_id, gid, bool_or(forced) AS forced, string_agg(s, ' ' ORDER BY i) AS content, sum(chars) AS chars FROM fold JOIN sentence USING (doc_id, i) GROUP BY doc_id, gid),
placed AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY doc_id ORDER BY gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS begun, {WORDS.format("content")} AS toks FROM grouped),
piece AS (SELECT doc_id, gid, 0 AS p, begun AS start_char, begun + length(content) AS end_char, content FROM placed WHERE NOT forced
          UNION ALL SELECT doc_id, gid, p, begun + trunc(p / n * chars)::INT, begun + trunc(least(p + {most}, n) / n * chars)::INT, array_to_string(toks[p + 1:p + {most}], ' ') FROM (SELECT *, len(toks) AS n, unnest(range(0, len(toks), {most})) AS p FROM placed WHERE forced)),
semantic AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY gid, p) - 1)::INT AS chunk_index, start_char::INT AS start_char, end_char::INT AS end_char, len({WORDS.format("content")}) AS n_tokens, content FROM piece)"""


CHUNK_ID = "substr(md5(doc_id || '_' || chunk_index || '_' || start_char), 1, 16) AS chunk_id"
SUMMARY = "count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99"
AB = """
side AS (SELECT event_type, user_id, round(avg(value), 9) AS f1, count(*)::DOUBLE AS faithfulness FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
pairs AS (SELECT v.user_id, unnest(['f1', 'faithfulness']) AS metric, unnest([v.f1, v.faithfulness]) AS a, unnest([c.f1, c.faithfulness]) AS b
          FROM side v JOIN side c USING (user_id) WHERE v.event_type = 'view' AND c.event_type = 'click')"""
#: Student's t by Simpson's rule on 2,000 steps.
TESTED = """
stat AS (SELECT metric, count(*) AS n, avg(b - a) AS md, CASE WHEN stddev_samp(b - a) > 1e-12 THEN stddev_samp(b - a) END AS sd, max(abs(a) + abs(b)) AS most FROM pairs GROUP BY 1),
t AS (SELECT metric, round(md, 6) AS difference, round(md / (sd / sqrt(n)), 6) AS t, (n - 1)::DOUBLE AS v FROM stat WHERE most > 0),
area AS (SELECT metric, sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs(t) * i / 2000, 2) / v, -(v + 1) / 2)) * abs(any_value(t)) / 6000 * exp(lgamma((any_value(v) + 1) / 2) - lgamma(any_value(v) / 2)) / sqrt(any_value(v) * pi()) AS half
         FROM t CROSS JOIN range(2001) r(i) WHERE t IS NOT NULL GROUP BY metric),
tested AS (SELECT metric, difference, coalesce(greatest(1 - 2 * half, 0), 1.0) AS p_value FROM t LEFT JOIN area USING (metric))"""
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8))


def scattered(x: str) -> str:
    for step in (48_271, 69_621, 39_373):
        x = f"list_transform([({x})::BIGINT], lambda x: (x * x + x * {step} + {step}) % 2147483647)[1]"
    return x


RATED = "rated AS (SELECT l.doc_id, quality, toxic, lang, n_chars FROM labels l JOIN documents USING (doc_id))"
ANNOTATIONS = f"""{RATED},
base AS (SELECT 'a' AS annotator_id, printf('s%04d', doc_id) AS sample_id, quality * 4 + 1 AS relevance, 5 - toxic * 4 AS faithfulness FROM rated
         UNION ALL SELECT 'b', printf('s%04d', doc_id), 3, NULL FROM rated WHERE lang = 'en')"""
PRICES = "prices(model, i, o) AS (VALUES ('qwen2.5-3b-instruct', 0.0::DOUBLE, 0.0::DOUBLE), ('mistral-small-latest', 0.2, 0.6), ('mistral-large-latest', 2.0, 6.0), ('gpt-4o', 2.5, 10.0), ('gpt-4o-mini', 0.15, 0.6), ('claude-3.5-sonnet', 3.0, 15.0))"
BUCKETS = (0.5, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0, 15.0)
_cum = ", ".join(f"count(*) FILTER (WHERE value / 10 <= {b}) AS b{i}" for i, b in enumerate(BUCKETS))


def _quantile() -> str:
    parts = []
    for i, b in enumerate(BUCKETS):
        low, under = (BUCKETS[i - 1], f"b{i - 1}") if i else (0.0, "0")
        parts.append(f"WHEN b{i} >= 0.95 * n THEN coalesce({low} + ({b} - {low}) * (0.95::DOUBLE * n - {under}) / nullif(b{i} - {under}, 0), {b})")
    return f"CASE {' '.join(parts)} ELSE {BUCKETS[-1]} END"


BREAKER = """WITH RECURSIVE s AS (SELECT user_id, event_id AS ord, epoch_us(ts) / 1e6 AS sec, value * 100 / 1000 * 0.004::DOUBLE + value * 100 / 10 / 1000 * 0.012::DOUBLE AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
            f AS (SELECT user_id, n, ord, sec AS start, cost AS cumulative FROM s WHERE n = 1
                  UNION ALL SELECT s.user_id, s.n, s.ord, CASE WHEN s.sec - f.start >= 86400 THEN s.sec ELSE f.start END, CASE WHEN s.sec - f.start >= 86400 THEN s.cost ELSE f.cumulative + s.cost END FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
            SELECT user_id, ord, round(cumulative, 6) AS cumulative, cumulative >= 50 AS open FROM f"""


CACHE = f"""WITH hit AS (SELECT q.vec_id AS lookup_id, e.vec_id AS entry_id, round({DOT.format("q.embedding", "e.embedding")}, 9) AS s FROM embeddings q JOIN embeddings e ON e.vec_id < q.vec_id AND q.vec_id - e.vec_id < 120),
            best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY s DESC, entry_id) AS r FROM hit WHERE s >= 0.5) WHERE r = 1)
            SELECT vec_id AS lookup_id, entry_id, round(s, 6) AS similarity, entry_id IS NOT NULL AS hit FROM embeddings LEFT JOIN best ON lookup_id = vec_id"""


def template(context: str, question: str) -> str:
    from .plans.adaptive import PROMPT

    text = PROMPT.replace("'", "''")
    return f"replace(replace('{text}', '{{context}}', {context}), '{{question}}', {question})"


def oracle_sql() -> dict[str, str]:
    docs5 = f"{PASSAGES},{bm25('passages', 5)}, docs AS (SELECT query_id, list(text ORDER BY rank) AS docs FROM bm25 JOIN documents USING (doc_id) GROUP BY 1)"
    block = "array_to_string(list_transform(docs, lambda x, i: '[' || i || '] ' || x), chr(10) || chr(10))"
    numbered = "array_to_string(list_transform(docs, lambda x, i: i || '. ' || substr(x, 1, 500)), chr(10))"
    recall = lambda ks: ", ".join(f"round(avg(coalesce(first <= {k}, false)::INT::DOUBLE), 6) AS recall_at_{k}" for k in ks)
    return {
        "bm25_stored": f"WITH {PASSAGES},{bm25('passages', 5)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM bm25",
        "bm25_topk": f"WITH {PASSAGES},{bm25('passages', 5)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM bm25",
        "bm25_filled": f"""WITH q AS (SELECT item_id AS query_id, list_sort(list_transform({TOKENS.format("text")}, lambda t: {{'n': -length(t), 't': t}}))[1].t AS query FROM benchmark),{bm25('q', 5)},
            spare AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10),
            few AS (SELECT query_id FROM q LEFT JOIN (SELECT query_id, count(*) AS n FROM scored GROUP BY 1) USING (query_id) WHERE coalesce(n, 0) < 5),
            filled AS (SELECT query_id, doc_id, score FROM scored UNION ALL SELECT query_id, doc_id, 0.0 FROM few CROSS JOIN spare WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM scored))
            SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM filled) WHERE rank <= 5""",
        "bm25_index_stats": f"WITH t AS (SELECT {TOKENS.format('text')} AS toks FROM documents) SELECT count(*) AS n_docs, round(avg(len(toks)), 6) AS avg_length, (SELECT count(DISTINCT x) FROM (SELECT unnest(toks) AS x FROM t)) AS vocabulary FROM t",
        "bm25_idf": f"""WITH df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS.format("text")})) AS term FROM documents) GROUP BY term),
            raw AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM df), mean AS (SELECT 0.25 * avg(raw) AS low FROM raw)
            SELECT term, df, round(CASE WHEN raw < 0 THEN low ELSE raw END, 6) AS idf FROM raw CROSS JOIN mean""",
        "dense_topk_cosine": f"WITH {VECTOR_QUERIES},{dense('vq', 10)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM dense",
        "dense_topk_l2": f"WITH {VECTOR_QUERIES},{dense('vq', 10, score=L2, order='ASC')} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM dense",
        "dense_label_precision": f"""WITH {VECTOR_QUERIES},{dense('vq', 11)}, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM dense WHERE query_id <> doc_id)
            SELECT near.query_id, round(avg((e.label = vq.label)::INT::DOUBLE), 6) AS precision FROM near JOIN embeddings e ON e.vec_id = near.doc_id JOIN vq ON vq.query_id = near.query_id WHERE r <= 10 GROUP BY 1""",
        "rrf_hybrid": f"WITH {RETRIEVAL},{fused(5)} SELECT query_id, rank, doc_id, round(rrf_score, 9) AS rrf_score, dense_rank, sparse_rank FROM hybrid",
        "rrf_weight_grid": f"""WITH {RETRIEVAL},{fused(5)}, w AS (SELECT i::INT AS pair, (10 - i) / 10.0::DOUBLE AS wd, i / 10.0::DOUBLE AS ws FROM range(11) t(i)),
            grid AS (SELECT *, row_number() OVER (PARTITION BY pair, query_id ORDER BY round(coalesce(wd / (60 + dense_rank), 0) + coalesce(ws / (60 + sparse_rank), 0), 12) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS r FROM sides CROSS JOIN w),
            firsts AS (SELECT pair, g.query_id, min(r) FILTER (WHERE r <= 5 AND grid.doc_id = g.doc_id) AS first FROM gold g CROSS JOIN w LEFT JOIN grid USING (pair, query_id) GROUP BY ALL)
            SELECT pair, count(*) AS n_queries, {recall([5])}, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM firsts GROUP BY pair""",
        "rrf_failure_cases": f"""WITH {RETRIEVAL},{fused(5)}, hit AS (SELECT query_id, (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM dense WHERE rank <= 5) AS a, (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM hybrid) AS b FROM gold)
            SELECT count(*) FILTER (WHERE NOT a AND b) AS improved, count(*) FILTER (WHERE a AND NOT b) AS degraded, count(*) FILTER (WHERE NOT a AND b) - count(*) FILTER (WHERE a AND NOT b) AS net, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM hit""",
        "recall_mrr": f"WITH {PASSAGES},{GOLD},{bm25('passages', 20)}, firsts AS (SELECT g.query_id, min(rank) AS first FROM gold g LEFT JOIN bm25 b ON b.query_id = g.query_id AND b.doc_id = g.doc_id GROUP BY 1) SELECT count(*) AS n_queries, {recall([1, 5, 10])}, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM firsts",
        "recall_by_config": f"""WITH {RETRIEVAL},{fused(20)}, every AS (SELECT 'bm25' AS config, query_id, doc_id, rank FROM bm25 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dense UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hybrid),
            firsts AS (SELECT c.config, g.query_id, min(rank) AS first FROM gold g CROSS JOIN (SELECT unnest(['bm25', 'dense', 'hybrid']) AS config) c LEFT JOIN every e ON e.config = c.config AND e.query_id = g.query_id AND e.doc_id = g.doc_id GROUP BY ALL)
            SELECT config, count(*) AS n_queries, {recall([1, 5])}, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM firsts GROUP BY config""",
        "gold_documents": f"WITH {PASSAGES},{GOLD} SELECT query_id, doc_id FROM containing",
        "rerank_lexical": f"WITH {PASSAGES},{bm25('passages', 20)},{RERANKED} SELECT query_id, rank, doc_id, prior_rank, round(rerank_score, 6) AS rerank_score FROM reranked",
        "rank_migration": f"""WITH {PASSAGES},{bm25('passages', 20)},{RERANKED} SELECT query_id, doc_id, prior_rank AS pre_rank, rank AS post_rank, prior_rank - rank AS delta,
            CASE WHEN rank < prior_rank THEN 'up' WHEN rank > prior_rank THEN 'down' ELSE 'same' END AS movement FROM reranked""",
        "chunk_fixed": f"SELECT {CHUNK_ID}, * FROM ({windows(128, 112, False)})",
        "chunk_sliding": f"SELECT {CHUNK_ID}, * FROM ({windows(128, 96, True)})",
        "chunk_semantic": f"WITH RECURSIVE {semantic(60, 100)} SELECT {CHUNK_ID}, * FROM semantic",
        "chunk_stats": f"""SELECT strategy, count(*) AS n_chunks, round(avg(length(content)), 6) AS avg_chars, min(length(content)) AS min_chars, max(length(content)) AS max_chars, round(stddev_pop(length(content)), 6) AS std_chars
            FROM (SELECT 'fixed' AS strategy, content FROM ({windows(128, 112, False)}) UNION ALL SELECT 'sliding', content FROM ({windows(128, 112, True)})) GROUP BY 1""",
        "doc_eda": f"""SELECT count(*) AS n_docs, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, sum(len({WORDS.format("text")}))::BIGINT AS words,
            round(avg(len({WORDS.format("text")})), 6) AS avg_words, count(DISTINCT source) AS sources, round(avg((lang = 'en')::INT::DOUBLE), 6) AS english_share FROM documents""",
        "doc_dedup_first": "SELECT doc_id, lang, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
        "top_sources": "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5",
        "qa_exact_match": f"WITH {TURNS},{F1} SELECT pair_id, exact_match, md5(array_to_string(b, ' ')) AS normalised_md5 FROM f1 JOIN tok USING (pair_id)",
        "qa_token_f1": f"WITH {TURNS},{F1} SELECT pair_id, round(f1, 6) AS f1 FROM f1",
        "qa_rouge_l": f"WITH RECURSIVE {TURNS},{LCS} SELECT pair_id, round(rouge_l, 6) AS rouge_l FROM rouge",
        "word_overlap_faithfulness": f"WITH {TURNS} SELECT pair_id, round({OVERLAP.format(_P, _T)}, 6) AS faithfulness, ({OVERLAP.format(_P, _T)} > 0.05)::BIGINT AS contributing FROM turns",
        "metric_aggregate": f"WITH RECURSIVE {AGGREGATE} SELECT * FROM agg",
        "config_deltas": f"""WITH RECURSIVE {AGGREGATE} SELECT a.config AS config_a, b.config AS config_b, a.metric, round(b.mean - a.mean, 6) AS delta, round(CASE WHEN a.mean = 0 THEN 0 ELSE (b.mean - a.mean) / a.mean END, 6) AS relative
            FROM agg a JOIN agg b ON a.metric = b.metric AND a.config < b.config""",
        "latency_stats": f"SELECT event_type, {SUMMARY} FROM events GROUP BY 1",
        "tracked_values": "SELECT user_id, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, round(coalesce(stddev_samp(value), 0), 6) AS std, count(value) AS count FROM events GROUP BY 1",
        "value_histogram": "SELECT bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 500, 10)) AS bin) LEFT JOIN (SELECT (floor(value / 10) * 10)::BIGINT AS bin, count(*) AS n FROM events WHERE value >= 0 AND value < 500 GROUP BY 1) USING (bin)",
        "turn_histogram": "SELECT turn, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(turn) FROM conversations) + 1)) AS turn) LEFT JOIN (SELECT turn, count(*) AS n FROM conversations GROUP BY 1) USING (turn)",
        "error_taxonomy": f"WITH RECURSIVE {CATEGORISED} SELECT pair_id, array_to_string(categories, ',') AS categories FROM categorised",
        "error_distribution": f"""WITH RECURSIVE {CATEGORISED}, names AS (SELECT unnest(['correct', 'empty_response', 'retrieval_failure', 'hallucination', 'low_context_relevance', 'incomplete_answer', 'verbose_answer', 'wrong_answer']) AS category),
            counted AS (SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM categorised) GROUP BY 1)
            SELECT category, coalesce(n, 0) AS n, (SELECT round(coalesce(1 - avg(list_contains(categories, 'correct')::INT::DOUBLE), 0), 6) FROM categorised) AS error_rate FROM names LEFT JOIN counted USING (category)""",
        "examples_per_category": f"WITH RECURSIVE {CATEGORISED} SELECT * FROM (SELECT pair_id, category, row_number() OVER (PARTITION BY category ORDER BY pair_id)::INT AS place FROM (SELECT pair_id, unnest(categories) AS category FROM categorised)) WHERE place <= 5",
        "worst_predictions": f"WITH RECURSIVE {RESULTS} SELECT pair_id, round(0.5 * f1 + 0.3 * faithfulness + 0.2 * exact_match, 6) AS badness FROM results ORDER BY badness, pair_id LIMIT 20",
        "ab_paired_stats": f"""WITH {AB}, s AS (SELECT metric, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(b - a) AS md, CASE WHEN stddev_samp(b - a) > 1e-12 THEN stddev_samp(b - a) END AS sd, max(abs(a) + abs(b)) AS most FROM pairs GROUP BY 1)
            SELECT metric, n, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(md, 6) AS difference, round(md / (sd / sqrt(n)), 6) AS t, n - 1 AS df, round(coalesce(md / sd, 0), 6) AS effect_size FROM s WHERE most > 0""",
        "ab_p_values": f"""WITH {AB},{TESTED} SELECT metric, round(p_value, 6) AS p_value, p_value < 0.05 AS significant FROM tested""",
        "ab_winner": f"""WITH {AB},{TESTED}, s AS (SELECT coalesce(bool_or(metric = 'faithfulness' AND p_value < 0.05 AND difference < 0), false) AS guard, coalesce(bool_or(metric = 'f1'), false) AS there, coalesce(bool_or(metric = 'f1' AND p_value < 0.05 AND difference > 0), false) AS better, coalesce(bool_or(metric = 'f1' AND p_value < 0.05 AND difference < 0), false) AS worse FROM tested)
            SELECT CASE WHEN guard OR there AND worse THEN 'champion' WHEN there AND better THEN 'challenger' ELSE 'no_significant_difference' END AS winner,
                   CASE WHEN guard THEN 'guard metric regressed' WHEN NOT there THEN 'primary metric not available' WHEN better THEN 'primary metric significantly better' WHEN worse THEN 'primary metric significantly worse' ELSE 'no significant difference' END AS reason FROM s""",
        "ab_bootstrap_ci": f"""WITH {AB}, rows AS (SELECT metric, b - a AS d, {scattered("(user_id % 2147483647 + 42) % 2147483647")} AS r FROM pairs),
            drawn AS (SELECT metric, resample, d, {scattered("(r + resample * 1000003) % 2147483647")} / 2147483647.0::DOUBLE AS u FROM rows CROSS JOIN range(1000) t(resample)),
            times AS (SELECT metric, resample, d, CASE {" ".join(f"WHEN u < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(POISSON))} ELSE {len(POISSON)} END AS k FROM drawn),
            means AS (SELECT metric, resample, sum(d * k) / sum(k) AS m FROM times WHERE k > 0 GROUP BY ALL)
            SELECT metric, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM means GROUP BY 1""",
        "stratified_sample": """WITH q AS (SELECT lang, greatest(1, round_even(50 * count(*) / (SELECT count(*) FROM documents)::DOUBLE, 0))::INT AS quota FROM documents GROUP BY 1),
            r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents)
            SELECT doc_id, r.lang FROM r JOIN q ON q.lang IS NOT DISTINCT FROM r.lang WHERE n <= quota ORDER BY n, md5('42:' || doc_id), doc_id LIMIT 50""",
        "kappa_quadratic": f"""WITH {RATED}, r AS (SELECT lang, (quality * 4 + 1)::DOUBLE AS x, (5 - toxic * 4)::DOUBLE AS y FROM rated), s AS (SELECT lang, count(*) AS n, sum((x - y) ** 2) AS dd, n * sum(x * x) + n * sum(y * y) - 2 * sum(x) * sum(y) AS below FROM r GROUP BY 1)
            SELECT lang, n, CASE WHEN below = 0 THEN CASE WHEN dd = 0 THEN 1.0 ELSE 'nan'::DOUBLE END ELSE round(1 - n * dd / below, 6) END AS kappa FROM s""",
        "spearman_ties": f"""WITH {RATED}, r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS rx, rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2 AS ry FROM rated)
            SELECT lang, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 3""",
        "annotation_means": f"""WITH {ANNOTATIONS} SELECT sample_id, count(DISTINCT annotator_id) AS n_annotators, round(coalesce(avg(relevance), 0), 6) AS relevance, round(coalesce(avg(faithfulness), 0), 6) AS faithfulness, 0.0::DOUBLE AS conciseness
            FROM base GROUP BY 1 HAVING count(DISTINCT annotator_id) >= 2""",
        "annotation_upsert": f"WITH {ANNOTATIONS} SELECT annotator_id, sample_id, (CASE annotator_id WHEN 'b' THEN 5 ELSE relevance END)::INT AS relevance, (CASE annotator_id WHEN 'b' THEN 2 ELSE 1 END)::INT AS version FROM base",
        "regression_check": f"""WITH RECURSIVE {AGGREGATE}, now AS (SELECT metric, mean FROM agg WHERE config = 'direct'), floors(metric, floor) AS (VALUES ('f1', 0.25::DOUBLE), ('rouge_l', 0.2), ('faithfulness', 0.4), ('exact_match', 0.05)), base(metric, base) AS (VALUES ('f1', 0.3::DOUBLE), ('faithfulness', 0.01), ('exact_match', 0.0))
            SELECT metric, CASE WHEN mean < floor THEN 'absolute' ELSE 'warning' END AS kind, round(mean, 6) AS current, NULL::DOUBLE AS reference, floor AS threshold FROM now JOIN floors USING (metric) WHERE mean < floor * 1.1
            UNION ALL SELECT metric, 'relative', round(mean, 6), base, 0.1::DOUBLE FROM now JOIN base USING (metric) WHERE base <> 0 AND (base - mean) / base > 0.1""",
        "cost_summary": f"""WITH {TURNS}, {PRICES}, usage AS (SELECT greatest(1, trunc(len({WORDS.format("truth")}) * 1.3::DOUBLE))::BIGINT AS i_t, greatest(1, trunc(len({WORDS.format("prediction")}) * 1.3::DOUBLE))::BIGINT AS o_t FROM turns)
            SELECT model, count(*) AS n_queries, sum(i_t)::BIGINT AS input_tokens, sum(o_t)::BIGINT AS output_tokens, round(avg(i_t), 6) AS avg_input, round(avg(o_t), 6) AS avg_output, round(sum((i_t * i + o_t * o) / 1e6), 8) AS total_cost, round(avg((i_t * i + o_t * o) / 1e6), 10) AS avg_cost FROM usage CROSS JOIN prices GROUP BY model""",
        "context_format": f"WITH {docs5} SELECT query_id, length({block}) AS n_chars, md5({block}) AS block_md5, md5({numbered}) AS numbered_md5 FROM docs",
        "prompt_build": f"WITH {docs5} SELECT query_id, md5({template(block, 'query')}) AS prompt_md5 FROM docs JOIN passages USING (query_id)",
        "grade_parse": """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN true ELSE quality = 1 END AS first, CASE WHEN doc_id % 4 = 3 THEN true ELSE toxic = 0 END AS second, quality = 1 AS said_yes FROM labels""",
        "adaptive_route": f"""WITH {PASSAGES},{bm25('passages', 20)},{RERANKED}, low AS (SELECT query_id, round(min(rerank_score), 6) AS low FROM reranked GROUP BY 1)
            SELECT query_id, coalesce(low, 0.0) AS min_rerank_score, CASE WHEN coalesce(low, 0) >= 0 THEN 'acceptable' ELSE 'fallback' END AS route FROM passages LEFT JOIN low USING (query_id)""",
        "web_merge": f"""WITH {PASSAGES},{bm25('passages', 4)}, every AS (SELECT query_id, rank AS ord, doc_id::VARCHAR AS document FROM bm25 UNION ALL SELECT page_id, 100, url FROM pages WHERE page_id IN (SELECT query_id FROM passages))
            SELECT * EXCLUDE (ord) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, document)::INT AS rank FROM every) WHERE rank <= 5""",
        "gt_match_three_tier": """WITH a AS (SELECT 'q' || item_id AS id, substr(text, 1, 40) AS question, item_id::VARCHAR AS answer FROM benchmark),
            q AS (SELECT CASE WHEN item_id % 3 = 0 THEN 'q' ELSE 'x' END || item_id AS query_id, CASE WHEN item_id % 3 = 1 THEN translate(substr(text, 1, 40), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE '- ' || substr(text, 1, 40) || '?!' END AS query FROM benchmark),
            t1 AS (SELECT id, min(answer) AS a1 FROM a GROUP BY 1), t2 AS (SELECT trim(lower(question)) AS k, arg_min(answer, id) AS a2 FROM a GROUP BY 1), t3 AS (SELECT regexp_replace(lower(question), '[^a-z0-9]+', '', 'g') AS k, arg_min(answer, id) AS a3 FROM a GROUP BY 1)
            SELECT query_id, query, coalesce(a1, a2, a3, '') AS answer FROM q LEFT JOIN t1 ON t1.id = query_id LEFT JOIN t2 ON t2.k = trim(lower(query)) LEFT JOIN t3 ON t3.k = regexp_replace(lower(query), '[^a-z0-9]+', '', 'g')""",
        "resume_antijoin": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "supporting_facts_recall": f"""WITH {PASSAGES},{GOLD},{bm25('passages', 10)}, g AS (SELECT query_id, list(DISTINCT doc_id) AS gold FROM containing GROUP BY 1), h AS (SELECT query_id, list(doc_id) AS found FROM bm25 GROUP BY 1)
            SELECT query_id, CASE WHEN gold IS NULL THEN 1.0 ELSE round(len(list_intersect(gold, coalesce(found, [])))::DOUBLE / len(gold), 6) END AS recall, CASE WHEN gold IS NULL THEN true ELSE len(list_intersect(gold, coalesce(found, []))) >= least(2, len(gold)) END AS accurate
            FROM passages LEFT JOIN g USING (query_id) LEFT JOIN h USING (query_id)""",
        "breaker_anchored": BREAKER,
        "rate_1m": "WITH c AS (SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY minute), 6) AS share FROM c",
        "hist_quantile": f"WITH c AS (SELECT event_type, count(*) AS n, {_cum} FROM events GROUP BY 1) SELECT event_type, n, round({_quantile()}, 6) AS quantile FROM c",
        "hist_buckets": f"WITH c AS (SELECT event_type, count(*) AS total, {_cum} FROM events GROUP BY 1) SELECT event_type, unnest([{', '.join(f'{b}::DOUBLE' for b in BUCKETS)}, NULL]) AS le, unnest([{', '.join(f'b{i}' for i in range(len(BUCKETS)))}, total]) AS n FROM c",
        "gauge_latest": "SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1",
        "semantic_cache_ttl": CACHE,
        "stream_cache": CACHE,
        "stream_breaker": BREAKER,
        "stream_window_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    }

"""Registered queries that SQL can't express, against plain Python over the same tables."""

import hashlib
import re

import numpy as np
import pytest

from larkspur import catalog
from larkspur.functions import text as T
from larkspur.functions.rouge import stem
from larkspur.operators import dense

D = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def turns(spark):
    return {r.pair_id: r for r in catalog.turns(spark, D).collect()}


def run(spark, name, *columns):
    return {r[columns[0]]: tuple(r[c] for c in columns[1:]) for r in catalog.queries()[name](spark, D).collect()}


def clean(a: str) -> str:
    a = re.sub("(?i)^answer:", "", a.strip(SPACE)).strip(SPACE)
    for phrase in ("\n\n", *T.STOP_PHRASES):
        a = a.split(phrase)[0].strip(SPACE)
    letters = lambda s: s.lower().replace(" ", "")
    parts = [x.strip(SPACE) + "." for x in a.split(".") if x.strip(SPACE)]
    if len(parts) > 1:
        kept = []
        for s in parts:
            if not any(len(set(letters(k)) & set(letters(s))) / max(len(letters(k)), len(letters(s))) > 0.8 for k in kept):
                kept.append(s)
        a = " ".join(kept)
    w = a.split()
    if re.search(r"(no|no\.|Given|This)$", a) and len(w) > 3:
        a = " ".join(w[:-1])
    return a.strip(SPACE)


def test_answer_cleanup(spark, turns):
    want = {i: clean(f"Answer: {r.prediction} Note: more.") for i, r in turns.items()}
    assert run(spark, "answer_cleanup", "pair_id", "n_chars", "answer_md5") == {i: (len(a), hashlib.md5(a.encode()).hexdigest()) for i, a in want.items()}


def rewrite(r: str, q: str) -> str:
    r = r.strip(SPACE).split("\n")[0].strip(SPACE)
    for p in T.REWRITE_PREFIXES:
        if r.lower().startswith(p.lower()):
            r = r[len(p) :].strip(SPACE)
    for mark in ("\"", "'"):
        if len(r) >= 2 and r[0] == mark == r[-1]:
            r = r[1:-1].strip(SPACE)
    r = re.sub("```[a-z]*", "", r).strip(SPACE)
    for s in T.SPEAKERS:
        if not r.startswith(s):
            r = r.split(s)[0].strip(SPACE)
    if "?" in r:
        r = r[: r.index("?") + 1]
    most = max(2 * len(q), 60)
    if len(r) > most:
        head = r[:most]
        r = head.rsplit(" ", 1)[0] if " " in head[1:] else head
    return q if len(r) < 3 else r


def test_rewrite_cleanup(spark, turns):
    assert run(spark, "rewrite_cleanup", "pair_id", "rewritten") == {i: (rewrite(f'Rewritten query: "{r.prediction}"', r.query),) for i, r in turns.items()}


def test_stemmed_rouge(spark, turns):
    def tokens(t):
        return [stem(w) if len(w) > 3 else w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]

    def score(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, before = [0] * (len(b) + 1), row
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        return round(2 * row[-1] / (len(a) + len(b)), 6) if a and b else 0.0

    got = run(spark, "qa_rouge_l_stemmed", "pair_id", "rouge_l")
    assert {i: v[0] for i, v in got.items()} == pytest.approx({i: score(tokens(r.prediction), tokens(r.ground_truth)) for i, r in turns.items()}, abs=2e-6)


def test_sentence_faithfulness(spark, turns):
    encode = dense.hashed_encoder()

    def unit(texts):
        v = np.asarray(encode(texts), dtype=np.float64)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n == 0, 1, n)

    want = {}
    for i, r in turns.items():
        sentences = [x.strip(SPACE) for x in r.prediction.split(".") if x.strip(SPACE)]
        if sentences:
            s = unit(sentences) @ unit(list(r.retrieved_contexts)).T
            want[i] = (round(float((s.max(axis=1) >= 0.65).mean()), 6),)
    assert run(spark, "sentence_faithfulness", "pair_id", "faithfulness") == want


def best_documents(spark):
    """The five best of each passage by the registered reranking, and the documents' texts."""
    texts = {r.doc_id: r.content for r in catalog.corpus(spark, D).collect()}
    hits = {}
    for r in catalog.queries()["rerank_lexical"](spark, D).orderBy("query_id", "rank").collect():
        hits.setdefault(r.query_id, []).append((r.doc_id, r.rerank_score))
    return texts, hits


def first_sentence(text: str) -> str:
    return re.split(r"(?<=[.!?])[ \t\n\v\f\r]+(?=[A-Z])", text)[0]


def test_linear_answers(spark):
    texts, hits = best_documents(spark)
    asked = [r.query_id for r in catalog.passages(spark, D).collect()]
    want = {i: (len(hits.get(i, [])), hashlib.md5(clean(first_sentence(texts[hits[i][0][0]]) if i in hits else "").encode()).hexdigest()) for i in asked}
    assert run(spark, "linear_answers", "query_id", "n_docs", "answer_md5") == want


def test_rates_are_those_of_the_states(spark):
    states = catalog.queries()["retry_unrolled"](spark, D).collect()
    rates = catalog.queries()["agentic_rates"](spark, D).first()
    n = len(states)
    assert rates.n == n
    assert rates.retry_rate == pytest.approx(sum(s.retry_count > 0 for s in states) / n, abs=1e-6)
    assert rates.avg_retries == pytest.approx(sum(s.retry_count for s in states) / n, abs=1e-6)
    assert rates.acceptable_rate == pytest.approx(sum(s.answer_is_acceptable for s in states) / n, abs=1e-6)
    assert rates.fallback_rate == pytest.approx(sum(s.used_fallback_retrieval for s in states) / n, abs=1e-6)
    assert rates.score_min == pytest.approx(min(s.min_rerank_score for s in states), abs=1e-6)


def test_retry_unrolled(spark):
    """The state machine by hand: fall back below the threshold, keep documents with a tenth of the query's words, answer, judge, try once more."""
    texts, hits = best_documents(spark)
    queries = {r.query_id: r.query for r in catalog.passages(spark, D).collect()}
    got = run(spark, "retry_unrolled", "query_id", "n_docs", "min_rerank_score", "used_fallback_retrieval", "num_docs_graded", "answer_is_acceptable", "retry_count", "n_steps")
    assert set(got) == set(queries)
    words = lambda t: [w for w in re.split(r"[ \t\n\v\f\r]+", t.lower()) if w]
    long_words = lambda t: set(re.findall(r"\w{4,}", t.lower()))
    for i, q in queries.items():
        n_docs, low, fell_back, graded, accepted, retries, steps = got[i]
        first = hits.get(i, [])
        assert fell_back == (min((s for _, s in first), default=0.0) < catalog.route_threshold())
        if fell_back:
            continue  # the wider retrieval's documents are not the registered ones
        terms = set(words(q))
        docs = [texts[d] for d, _ in first]
        kept = [t for t in docs if len(terms & set(words(t))) / max(len(terms), 1) >= 0.1]
        assert graded == len(kept)
        docs = kept or docs
        ok, tries = False, 0
        for attempt in range(2):
            answer = clean(first_sentence(docs[attempt]) if attempt < len(docs[:5]) else "")
            mine = long_words(answer)
            ok = answer.strip(SPACE) != "" and len(mine & set().union(*map(long_words, docs), set())) / max(len(mine), 1) >= 0.5
            tries += not ok
            if ok:
                break
        assert (n_docs, accepted, retries) == (len(docs), ok, tries)
        assert steps == 2 + 2 * (attempt + 1)

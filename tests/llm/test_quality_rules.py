import re
from collections import Counter, defaultdict

import numpy as np

from larkspur.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), sum(n - 1 for n in Counter(lines).values()), len(covered)


def test_base_counts_equal_brute_force(spark, odd_docs, no_docs):
    texts = ["a b c d e f a b c d e g", "x x x x x x x", "é#é\n\na\na\n a\n", "one\ntwo\none", "|" * 40, " ".join(map(str, range(200))), "a b c d e\na b c d e"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df in (docs, odd_docs.select("doc_id", "text"), no_docs.select("doc_id", "text")):
        want = sorted((brute(r.text) for r in df.collect()))
        got = qr.quality_report(df).collect()
        assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)


def test_votes_separate_junk_from_prose(spark):
    import random

    rng = random.Random(4)
    stop = "the of and to in a is that for on".split()
    prose = lambda: " ".join(rng.choice(stop) if rng.random() < 0.4 else "".join(rng.choice("abcdelmnorst") for _ in range(rng.randrange(3, 9))) for _ in range(120))
    junk = lambda: " ".join("".join(rng.choice("abcdelmnorst") for _ in range(5)) + rng.choice(["###", "$$$", "***"]) for _ in range(120))
    docs = spark.createDataFrame([(i, junk() if i % 10 == 0 else prose()) for i in range(200)], "doc_id long, text string")
    assert {r.doc_id for r in qr.quality(docs).where("not kept").collect()} == set(range(0, 200, 10))


def sampled(rng, n, share, accuracies, cast=0.8):
    """Classes, and votes of rules of these (right on good, right on bad) accuracies that abstain at random."""
    good = rng.random(n) < share
    votes = np.stack([np.where(rng.random(n) < np.where(good, a, b), np.where(good, 1, -1), np.where(good, -1, 1)) * (rng.random(n) < cast) for a, b in accuracies], axis=1)
    return good, votes


def test_em_recovers_accuracies():
    """With the settings of the query, from votes alone: accuracies, the share of good documents, and verdicts."""
    accuracies = [(0.97, 0.8), (0.95, 0.7), (0.9, 0.6), (0.98, 0.55), (0.85, 0.75), (0.93, 0.4)]
    good, votes = sampled(np.random.default_rng(0), 40_000, 0.85, accuracies)
    table, counts = np.unique(votes, axis=0, return_counts=True)
    weights, bias = qr.fit_votes(table, counts.astype(float))
    for i, (a, b) in enumerate(accuracies):
        assert abs(weights[i, 2] - np.log(a / (1 - b))) < 0.15 and abs(weights[i, 0] - np.log((1 - a) / b)) < 0.25
    assert abs(bias - np.log(0.85 / 0.15)) < 0.15
    score = bias + sum(weights[i, votes[:, i] + 1] for i in range(len(accuracies)))
    against = (votes < 0).sum(axis=1)
    assert ((score > 0) == good).mean() > 0.93
    assert (score[against == 1] > 0).mean() > 0.9  # one vote against is no verdict
    assert 0 < (score[against == 2] > 0).mean() < 1


def test_verdicts_equal_a_plain_em(spark):
    """The query's posteriors against EM document by document in plain Python."""
    import math
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdelmnorst") for _ in range(rng.randrange(2, 9)))
    lexicon = [word() for _ in range(60)]
    rows = []
    for i in range(150):
        words = [rng.choice(lexicon) if rng.random() < (0.9 if i % 6 else 0.2) else word() + rng.choice(["", "", "#", "$$"] if i % 6 == 0 else [""] * 30 + ["1"]) for _ in range(rng.choice([12, 40, 130]))]
        rows.append((i, " ".join(words)))
    got = qr.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = [f"vote_{k}" for k in qr.rule_votes()]
    votes = [[r[x] for x in names] for r in got]
    theta, share = {c: [x] * len(names) for c, x in ((0, 0.4), (1, 0.9))}, 0.9
    for _ in range(1000):
        posterior = []
        for v in votes:
            like = [1 - share, share]
            for c in (0, 1):
                for k, x in enumerate(v):
                    like[c] *= theta[c][k] if x > 0 else 1 - theta[c][k] if x < 0 else 1
            posterior.append(like[1] / sum(like))
        new = {}
        for c, x in ((1, 0.9), (0, 0.4)):
            w = [p if c else 1 - p for p in posterior]
            new[c] = [(sum(a for a, v in zip(w, votes, strict=True) if v[k] > 0) + x) / (sum(a for a, v in zip(w, votes, strict=True) if v[k]) + 1) for k in range(len(names))]
        new[0] = [min(a, b) for a, b in zip(new[0], new[1], strict=True)]
        moved = max(abs(a - b) for c in (0, 1) for a, b in zip(new[c], theta[c], strict=True))
        theta, share = new, (sum(posterior) + 0.9) / (len(rows) + 1)
        if moved < 1e-9:
            break
    for r, p in zip(got, posterior, strict=True):
        assert math.isclose(r.posterior, p, abs_tol=1e-4)
        assert r.kept == (not r.base_failed and p >= 0.5)


SCRIPTS = {"english": "abcdefghilmnoprstu", "russian": "абвгдежзиклмнопрсту", "hindi": "कखगचजटतदनपबमयरलवशसहािीेो", "korean": "가나다라마바사아자차카타파하고노도로", "thai": "กขคงจชดตนบปมยรลวสอาิีุเแ", "chinese": "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年"}


def test_clean_texts_of_every_script_are_kept_alike(spark):
    import random

    rng, rows, junk = random.Random(6), [], []
    for k, (name, letters) in enumerate(SCRIPTS.items()):
        unspaced = name in ("thai", "chinese")
        lexicon = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(400)]
        for i in range(600 if name == "english" else 100):
            words = [lexicon[int(400 * rng.random() ** 3)] for _ in range(240)]
            rows.append((1000 * k + i, " ".join("".join(words[j : j + 8]) for j in range(0, 240, 8)) if unspaced else " ".join(words)))
    for i in range(80):
        junk.append((9000 + i, " ".join(rng.choice("abcdefgh") * 3 + rng.choice(["###", "$$$"]) for _ in range(100)) if i % 2 else " ".join(f"{rng.randrange(10**9)}" for _ in range(60))))
    kept = {r.doc_id: r.kept for r in qr.quality_report(spark.createDataFrame(rows + junk, "doc_id long, text string")).collect()}
    assert all(kept[i] for i, _ in rows)
    assert not any(kept[i] for i, _ in junk)

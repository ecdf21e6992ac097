import corpus_pipeline as cp

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_a_small_corpus(spark, tmp_path):
    import random

    rng = random.Random(9)
    words = {"en": "the of and to in with that this house water stone".split(), "de": "der die und zu von mit das haus wasser nicht stein".split()}
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        text = "\n".join(" ".join(rng.choice(words[lang]) + rng.choice(["", "er", "en"]) for _ in range(12)) for _ in range(4)) + "\nCopyright line"
        rows.append((i, text, lang, f"s{i % 4}"))
    rows += [(500 + i, rows[i][1], rows[i][2], "s9") for i in range(5)]  # exact copies
    rows += [(600, "12345 !!", "en", "s0"), (601, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == DOCUMENTS
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert ids("language_id") == {*range(120), *range(500, 505)}
    assert sum("Copyright line" in r.text for r in seen["line_dedup"].collect()) == 1
    assert ids("ngram_join") == set(range(120)) and seen["ngram_join"].count() == 120
    assert ids("source_mixing") == set(range(120)) and seen["source_mixing"].count() >= 120
    packed = seen["packing"]
    assert ids("packing") == set(range(120)) and packed.where("piece = 0").count() == seen["source_mixing"].count()


def brute(rows, by_lang):
    """What run() keeps, step by step and plainly: (doc_id, tokens with the end mark) once for each document left."""
    from collections import Counter, defaultdict

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(cp.default_tokenizer())
    rows = [r for r in rows if r[1] is not None and any(ch.isalpha() for ch in r[1])]
    at = defaultdict(set)
    for i, text, _, _ in rows:
        for line in text.split("\n"):
            at[line.strip(" \t\n\v\f\r").lower()].add(i)
    left, seen = [], set()
    for i, text, lang, source in sorted(rows):
        lines = []
        for line in text.split("\n"):
            key = line.strip(" \t\n\v\f\r").lower()
            if key and len(at[key]) >= 10 and key in seen:
                continue
            seen.add(key)
            lines.append(line)
        if "".join(lines).split():
            left.append((i, "\n".join(lines), source))
    sets = {}
    for i, text, _ in left:
        w = text.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    up = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = {k: a if v == b else v for k, v in up.items()}
    left = [r for r in left if up[r[0]] == r[0]]
    return {i: len(library.encode(text, add_special_tokens=False).ids) + 1 for i, text, _ in left}, Counter(s for _, _, s in left)


def test_run_equals_brute_force(spark, tmp_path):
    import random

    rng = random.Random(11)
    words = {"en": "the of and to in with that this house water stone".split(), "de": "der die und zu von mit das haus wasser nicht stein".split()}
    rows = []
    for i in range(100):
        lang = "en" if i % 2 else "de"
        text = "\n".join(" ".join(rng.choice(words[lang]) + rng.choice(["", "er", "en"]) for _ in range(12)) for _ in range(rng.randrange(2, 30))) + "\nAll rights reserved"
        rows.append((i, text, lang, f"s{i % 3}"))
    rows += [(200 + i, rows[i][1] + " more", rows[i][2], "s0") for i in range(20)] + [(300, "98765 ##", "en", "s1"), (301, None, "de", "s1")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path)).collect()
    want, _ = brute(rows, words)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, 0)
        got[r.doc_id] += r.length
    assert set(got) == set(want)
    assert all(got[i] % n == 0 for i, n in want.items())  # as often as the mixture reads it, whole each time
    filled = {}
    for r in out:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 1024 and sorted(p)[0][0] == 0 for p in filled.values())


def test_null_ids_and_repeated_rows_go_through(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "key", "score")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        if name != "packing":
            assert docs.columns == odd_docs.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_empty_input(spark, no_docs):
    docs = no_docs
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0

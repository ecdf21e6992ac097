import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import packing as pk

TOKENIZER = pk.default_tokenizer()
ENCODER = pk.Encoder(TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def ids_of(texts):
    out = []
    for c in pk.chunks(pa.array(texts)):
        ids, begin = ENCODER.encode(c.data, c.offsets)
        out += [ids[begin[i] : begin[i + 1]].tolist() for i in range(c.n)]
    return out


def test_ids_of_plain_cases(plain):
    odd = ["", "a", " a", "  a  b\n\n c\t d", "x\n", "it's we'll 'tis \"'s\"", "é 12 3a b 　c", "  ", "\n \n", "a\u0085b 日本語 \U0001f600!! <|endoftext|>", " \n a", "٣ ²½ x", "a 　 b", None]
    assert ids_of(odd) == [plain(s or "") for s in odd]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB9é'.! \n\t　́-", max_size=30), max_size=4))
def test_ids_equal_the_tokenizer(plain, texts):
    texts = [*texts, "<|endoftext|>".join(texts)]
    assert ids_of(texts) == [plain(s) for s in texts]


@given(st.lists(st.integers(1, 64), min_size=1, max_size=300), st.integers(1, 40))
def test_bins_never_overflow_and_are_gapless(sizes, most):
    bins = pk.OpenBins(64, most)
    used = defaultdict(int)
    for s in sizes:
        b, at = bins.place(s)
        assert used[b] == at
        used[b] += s
        assert used[b] <= 64 and bins.open <= most
    if most >= len(sizes):  # best fit leaves at most one bin under half
        assert sum(2 * u <= 64 for u in used.values()) <= 1


def rebuilt(rows, texts, plain, length):
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for doc, text in texts:
        ids, at = [*plain(text or ""), 2], 0
        for r in sorted(pieces[doc], key=lambda r: r.piece):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and len(part) == r.length and (r.piece == 0 or r.length == length)
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(seqs)


def test_every_token_is_placed_once(spark, plain):
    texts = [(i, ("word number %d, " % i) * (i % 70)) for i in range(200)] + [(900, None)]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, length string")
    rows = pk.pack(df, TOKENIZER, 128, 2).collect()
    n = rebuilt(rows, texts, plain, 128)
    assert n <= 1.05 * sum(r.length for r in rows) / 128 + 2
    assert {r.doc_id for r in rows if r.piece == 0} == {t[0] for t in texts}
    many = pk.pack(df, TOKENIZER, 128, 2, open_bins=4, group_pieces=100).collect()
    rebuilt(many, texts, plain, 128)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pk.pack(odd_docs, TOKENIZER, 1024, 2).collect()
    assert sum(r.piece == 0 for r in rows) == odd_docs.count()
    assert pk.pack(no_docs, TOKENIZER).count() == 0


def test_added_tokens_have_the_ids_of_the_library_default(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    assert pk.added_strings(TOKENIZER)
    texts = [(i, t) for i, t in enumerate(["a <|endoftext|> b", "it's<|endoftext|>", "plain <|endof", "text|> plain", "<|endoftext|>", ""])]
    rows = pk.pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), TOKENIZER, 128, 2).collect()
    rebuilt(rows, texts, lambda s: library.encode(s, add_special_tokens=False).ids, 128)

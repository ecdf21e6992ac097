"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become token ids by one vectorised pass: texts are cut into
pre-tokens with array operations over code points, each distinct pre-token is
encoded once a task, and ids are gathered back.  Texts with
an apostrophe (contractions) go to the tokenizer whole.  The merge loop is
tiktoken's in place of the tokenizers library's, for the same ids; texts that
hold the string of an added token go to the tokenizers library whole.  A document's ids end
with `end_id`; longer ones are cut from their end into full pieces, so only the
first piece can be shorter.

Pieces, as small rows without ids, are dealt by hash into groups of about
`group_pieces`; each group is packed by bounded-space online best fit: open
bins sit in lists keyed by free space, a bitset has a bit for every free space
that some bin has, the lowest set bit at or above a length is the best fit,
and when more than `open_bins` are open the fullest closes.  Groups are sorted
by a hash first, so a task that runs again gives the same places.

Defined results: a null text is empty (one piece of one id); repeated rows and
null ids are documents of their own; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, chunks, mix, trim, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def char_classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, by code point, as the tokenizer's pattern has them."""
    import regex

    out = np.full(0x110000, 3, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((0, r"\s"), (1, r"\p{L}"), (2, r"\p{N}")):
        out[[ord(m) for m in regex.findall(pattern, every)]] = kind
    return out


def pretoken_starts(cp: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in code points cp; a text begins at each of bounds.

    A run of one class is a pre-token; a space right before a run of another
    class joins it, and of a longer white run only its last character is apart.
    """
    kind = classes[cp]
    n = len(cp)
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[bounds] = True
    text_start = text_start[:n]
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= text_start
    white = kind == 0
    before_solid = np.zeros(n, dtype=bool)  # a white character right before a solid one of the same text
    before_solid[:-1] = white[:-1] & ~white[1:] & ~text_start[1:]
    begins = change | before_solid
    joined = np.zeros(n, dtype=bool)
    joined[1:] = before_solid[:-1] & (cp[:-1] == 32)
    return np.flatnonzero(begins & ~joined | text_start)


#: Fixed value: the pattern of this family of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level_encoding(tokenizer_path: str):
    """The byte-level BPE of a tokenizers file with tiktoken's faster merge loop.

    In these files ids are merge ranks and a token's letters stand for bytes:
    printable bytes for themselves, the others, in order, for U+0100 onwards.
    """
    import json

    import tiktoken

    with open(tokenizer_path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(letter[ch] for ch in token): i for token, i in vocab.items() if all(ch in letter for ch in token) and token != "<|endoftext|>"}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_strings(tokenizer_path: str) -> list[bytes]:
    import json

    with open(tokenizer_path, encoding="utf-8") as f:
        return [t["content"].encode() for t in json.load(f).get("added_tokens") or []]


class Encoder:
    """Token ids of texts, in batches; made once a task."""

    LIMIT = 150_000

    def __init__(self, tokenizer_path: str) -> None:
        self.path, self.library = tokenizer_path, None
        self.added = added_strings(tokenizer_path)  # their strings in a text become their ids, as with the library's default setting
        self.encoding = byte_level_encoding(tokenizer_path)
        self.token_bytes = np.asarray([len(self.encoding.decode_single_token_bytes(i)) for i in range(self.encoding.n_vocab)])
        self.classes = char_classes()
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.at, self.len = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.made = self.used = 0
        self.hasher = SpanHasher()

    def _by_library(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces that begin with a space meet no other piece's merges, so they go through the encoding as one text."""
        apart = lambda p: p[0] == 32 and len(p) > 1 and p[1] > 32 and p[1] not in (0xC2, 0xE1, 0xE2, 0xE3)  # noqa: E731  the latter may begin other white space
        spaced = [p for p in pieces if apart(p)]
        if spaced:
            ids = np.asarray(self.encoding._core_bpe.encode_ordinary(b"".join(spaced).decode()), dtype=np.int32)
            ends = np.cumsum(self.token_bytes[ids])
            cut = np.searchsorted(ends, np.cumsum([len(p) for p in spaced])) + 1
            if len(ends) and np.array_equal(ends[cut - 1], np.cumsum([len(p) for p in spaced])):
                self._store(spaced, ids, np.diff(cut, prepend=0))
                pieces = [p for p in pieces if not apart(p)]
        if pieces:
            each = [self.encoding._core_bpe.encode_single_piece(p) for p in pieces]
            self._store(pieces, np.asarray([i for ids in each for i in ids], dtype=np.int32), np.asarray([len(ids) for ids in each]))

    def _store(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.made + len(sizes) > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len))
        self.flat[self.used : self.used + len(ids)] = ids
        at = slice(self.made, self.made + len(sizes))
        self.at[at], self.len[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.known.update(zip(pieces, range(self.made, self.made + len(sizes)), strict=True))
        self.used += len(ids)
        self.made += len(sizes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and where each text's begin."""
        text_n = len(offsets) - 1
        raw = data.tobytes()
        lead = (data & 0xC0) != 0x80
        pos = np.flatnonzero(lead)  # byte of every code point
        cp = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
        bounds = np.searchsorted(pos, offsets)
        odd = np.zeros(text_n, dtype=bool)
        odd[np.searchsorted(offsets, np.flatnonzero(data == 39), side="right") - 1] = True
        found = {int(np.searchsorted(offsets, m.start(), side="right")) - 1 for s in self.added for m in re.finditer(re.escape(s), raw)}
        odd[list(found)] = True
        full = np.flatnonzero(np.diff(bounds) > 0)
        begins = pretoken_starts(cp, bounds[:-1][full], self.classes)
        byte_at = np.concatenate([pos, [len(data)]])
        b0, b1 = byte_at[begins], byte_at[np.concatenate([begins[1:], [len(cp)]]) if len(begins) else begins]
        text_of = np.searchsorted(offsets, b0, side="right") - 1
        if odd.any():
            use = ~odd[text_of]
            b0, b1, text_of = b0[use], b1[use], text_of[use]
        _, sample, which = np.unique(self.hasher.spans(data, b0, b1), return_index=True, return_inverse=True)
        words = [raw[a:b] for a, b in zip(b0[sample].tolist(), b1[sample].tolist(), strict=True)]
        if len(self.known) > self.LIMIT:
            self.known, self.made, self.used = {}, 0, 0
        missing = [w for w in words if w not in self.known]
        if missing:
            self._learn(missing)
        which = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))[which]
        at, size = self.at[which], self.len[which]
        per_text = np.bincount(text_of, weights=size, minlength=text_n).astype(np.int64) if len(which) else np.zeros(text_n, np.int64)
        whole = {}
        for t in np.flatnonzero(odd):
            text = raw[offsets[t] : offsets[t + 1]].decode()
            ids = self._by_library(text) if int(t) in found else self.encoding.encode_ordinary(text)
            whole[int(t)] = np.asarray(ids, dtype=np.int32)
            per_text[t] = len(ids)
        begin = np.concatenate([[0], np.cumsum(per_text)])
        out = np.zeros(begin[-1], dtype=np.int32)
        if len(which):
            total = int(size.sum())
            ends = np.cumsum(size)
            take = np.repeat(at - (ends - size), size) + np.arange(total)
            dest = np.ones(begin[-1], dtype=bool)
            for t in whole:
                dest[begin[t] : begin[t + 1]] = False
            out[dest] = self.flat[take]
        for t, ids in whole.items():
            out[begin[t] : begin[t + 1]] = ids
        return out, begin


def piece_rows(docs: DataFrame, tokenizer_path: str, length: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of docs (see PIECES; with_ids adds the ids).  row tells equal ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trim()
        encoder, seen = Encoder(tokenizer_path), 0
        task = TaskContext.get().partitionId() << 40
        for b in batches:
            doc = b.column("doc_id")
            for c in chunks(b.column("text"), 1 << 20):
                ids, begin = encoder.encode(c.data, c.offsets)
                n = np.diff(begin) + 1
                pieces = -(-n // length)
                row = np.repeat(np.arange(c.n), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * length
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * length)
                size = np.where(piece == 0, head[row], length)
                every = np.full(len(ids) + c.n, end_id, dtype="<u4")
                own = np.ones(len(every), dtype=bool)
                own[begin[1:] + np.arange(c.n)] = False
                every[own] = ids
                at = begin[row] + row + start
                view = memoryview(every.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), size.tolist(), strict=True)]
                cols = [doc.take(pa.array(c.first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(task + seen + row)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
                if with_ids:
                    cols.append(pa.array([every[a : a + k].astype(np.int32) for a, k in zip(at.tolist(), size.tolist(), strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                seen += c.n
                yield pa.RecordBatch.from_arrays(cols, names=names)
        del encoder
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


class OpenBins:
    """Bounded-space online best fit."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset that a piece of this size gets."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - free

    def _take(self, free: int) -> int:
        self.open -= 1
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        return bin_


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 2, open_bins: int = 2048, group_pieces: int = 65_536) -> DataFrame:
    """The place of every piece: PLACED.  sequence_id is the group's number times 2^32 plus the bin's."""
    pieces = written(piece_rows(docs, tokenizer_path, length, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def fill(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        row, piece, size = (table.column(n).to_numpy() for n in ("row", "piece", "length"))
        order = np.lexsort((piece, row, mix(row.astype(np.uint64) * np.uint64(4096) + piece.astype(np.uint64))))
        bins, seq, off = OpenBins(length, open_bins), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for i in order.tolist():
            seq[i], off[i] = bins.place(int(size[i]))
        return pa.table({**{n: table.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": pa.array((group << 32) + seq), "offset": pa.array(off)})

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(fill, PLACED)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


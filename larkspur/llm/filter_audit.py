"""Filter interaction audit: what each filter removes, alone and in every order.

Duplicates are found by partition refinement.  All texts begin as one class a
code-point length; then one block of each text after the other is hashed, each
eight times as long as the last and the final one as long as the rest of the
text, and a class falls apart by its members' hashes.  After every step
classes of one member go, so later steps see fewer rows; only keys travel.
Texts that are together to the end are compared whole: a class holds its
distinct texts (one, unless hashes met), aggregated where they lie before they
travel, and every row but those of the least doc_id of a text is a duplicate.

Each row's failed filters are then a mask of five bits.  Masks are counted a
part, and all orders' numbers are sums over at most 32 counts a part.

Defined results: a null text is empty (it fails A, and E beside a smaller
doc_id's empty text); a null doc_id counts as smaller than any other and has no
labels; rows of one doc_id are no copies of each other; a repeated row counts
each time; a doc_id of several labels is good or toxic if any of them says so;
a null source is the part ''; other columns are not read; no documents, no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LETTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
#: Code points of the first block; each next one is eight times as long.  The last of BLOCKS takes the rest.
FIRST_BLOCK, BLOCKS = 64, 4
NO_ID = -(1 << 63)


def block_hashes(text: Column, bits: int = 64) -> list[Column]:
    """Hashes of the successive blocks of a text, which they cover."""
    out, at, size = [], 1, FIRST_BLOCK
    for k in range(BLOCKS):
        block = F.substring(text, at, size) if k < BLOCKS - 1 else F.substr(text, F.lit(at))
        h = F.xxhash64(block)
        out.append((h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)).alias(f"h{k}"))
        at, size = at + size, size * 8
    return out


def text_failures(text: Column) -> Column:
    """The bits of A to D that a text fails."""
    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def keyed(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc, rk (a hash of the whole text, so that doc and rk name a row), part, mask of A to D, length and block hashes."""
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("source", F.lit("")).alias("part"), t.alias("text"))
    return rows.select("doc", F.xxhash64("text").alias("rk"), "part", text_failures(F.col("text")).alias("mask"), F.length("text").cast("long").alias("cls"), *block_hashes(F.col("text"), bits))


def refined(keys: DataFrame) -> DataFrame:
    """(doc, rk, cls) of the rows that share length and all block hashes with another row."""
    live = keys.select("doc", "rk", "cls", *[f"h{k}" for k in range(BLOCKS)])
    for k in range(BLOCKS + 1):
        several = live.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
        kept = live.join(several.hint("merge"), "cls", "left_semi")
        if k < BLOCKS:
            kept = kept.withColumn("cls", F.xxhash64("cls", f"h{k}")).drop(f"h{k}")
        live = written(kept, f"classes-{k}")
    return live


def of_live(rows: DataFrame, live: DataFrame) -> DataFrame:
    """rows (with rk) that may be in live: a bit for each rk, 64 a word and at most 2^20 words, goes to where the texts are, so that few others travel."""
    word, bit = F.expr(f"rk & {(1 << 20) - 1}").alias("word"), F.expr("shiftleft(1L, cast(shiftright(rk, 20) & 63 AS int))").alias("bit")
    bits = live.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word").where("bits & bit <> 0").drop("word", "bit", "bits")


def duplicates(docs: DataFrame, bits: int = 64, keys: DataFrame | None = None) -> DataFrame:
    """(doc, rk) of the rows whose text a smaller doc_id has; bits are the size of the block hashes."""
    live = refined(keys if keys is not None else keyed(docs, bits))
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(t).alias("rk"), t.alias("text"))
    texts = of_live(rows, live).join(live.distinct().hint("merge"), ["doc", "rk"])  # live grows with the input: never broadcast
    firsts = written(texts.groupBy("cls", "text").agg(F.min("doc").alias("first")), "class-texts")
    of_class = firsts.groupBy("cls").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    out = live.join(of_class.where("n = 1").hint("merge"), "cls").where("doc > first").select("doc", "rk")
    mixed = of_class.where("n > 1").select("cls")  # hashes of unlike texts met
    if not mixed.isEmpty():
        out = out.unionByName(texts.join(mixed, "cls", "left_semi").join(firsts, ["cls", "text"]).where("doc > first").select("doc", "rk"))
    return out.distinct()


def masks(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail."""
    keys = written(keyed(docs, bits), "filter-keys")
    copies = duplicates(docs, bits, keys).withColumn("copy", F.lit(1 << 4))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = keys.select("doc", "rk", "part", "mask").join(copies.hint("merge"), ["doc", "rk"], "left").join(said.hint("merge"), "doc", "left")
    mask = (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask")
    count = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    return rows.select("part", mask, "good", "toxic").groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def steps(spark) -> DataFrame:
    """The 600 steps of all orders: the filter's bit, and the bits of those before it."""
    rows = []
    for order in permutations(LETTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << LETTERS.index(letter)
            rows.append(("".join(order), k + 1, bit, before))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def filter_audit(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """A row a part, order and step, with the counts at that step."""
    counted = written(masks(docs, labels, bits), "masks")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, c="n": F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    first = len(list(permutations(LETTERS))) / F.bit_count("mask")  # orders in which a filter comes before the others of a mask
    return (
        counted.join(F.broadcast(steps(docs.sparkSession)))  # 600 rows, at most 32 masks a part
        .groupBy("part", "filter_order", "step", "bit")
        .agg(
            total(~fails & ~earlier).alias("kept"),
            total(fails & ~earlier).alias("removed"),
            total(fails & earlier).alias("redundant"),
            total(F.col("mask") == F.col("bit")).alias("unique_fails"),
            total(fails & ~earlier, "good").alias("good_lost"),
            total(fails & ~earlier, "toxic").alias("toxic_lost"),
            F.coalesce(F.sum(F.when(fails, F.col("n") * first.cast("long"))), F.lit(0)).cast("long").alias("shapley"),
        )
        .drop("bit")
    )

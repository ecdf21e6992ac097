"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens raised to an exponent, normalised.
Exponent 1 keeps the corpus as it is, 0 makes all sources equal.  The exponent
is found by bisection, many points at once: every round adds up, in one
aggregate over the sources, what the targets need at 64 exponents and narrows
the interval 63 times, so no list of sources reaches the driver.  Targets: an
entropy of the weights, a limit on
repetition (the largest epoch count over the smallest), or both; the entropy
asked is a share of the way from the corpus' own to the largest possible, so it
asks for something wherever sources differ in size.  The exponent is the least
flattening that meets the entropy, held back by the repetition limit, which
comes first.

The budget is the least that leaves every source one whole epoch, so nothing
is dropped: the source with the lowest rate is read once and others more.
Epochs are realised as block permutations: a source's rows are dealt by hash
into `blocks` blocks, whatever its size; every epoch has its own order of them,
by a hash of (source, epoch, block), and a row carries its epoch, its block and
the block's place in the epoch.  Whole epochs take all blocks, the partial last one takes them in
its order until its budget is met; a block at the border is taken if at least
half of it fits.

Tokens are words [^\\x20\\x09-\\x0D]+.  All steps are DataFrame operations.

Defined results: a null source is a source of its own; a text that is null or
has no words counts 1 token, so it is dealt like others; repeated rows are rows
of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

POINTS = 64


def tokens(text: Column) -> Column:
    """Words of a text, at least 1."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.greatest(F.lit(1), F.length(spaced) - F.length(F.replace(spaced, F.lit(" "))) + F.when(spaced == "", 0).otherwise(1)).cast("long")


@dataclass(frozen=True)
class Mix:
    exponent: float
    total: int
    log_norm: float  # log of the sum of shares ** exponent
    log_scale: float  # log of the budget over all tokens


def choose_exponent(totals: DataFrame, entropy_share: float | None, most_repetition: float | None, rounds: int = 4) -> Mix:
    """The exponent for per-source totals (src_tokens)."""
    t = F.col("src_tokens")
    head = totals.agg(F.sum(t).alias("all"), F.count("*").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    if not head["all"]:
        return Mix(1.0, 0, 0.0, 0.0)
    share = F.log(t / F.lit(float(head["all"])))

    def sums(xs: list[float]) -> list[tuple[float, float]]:
        row = totals.agg(*[F.sum(F.exp(share * x)).alias(f"z{i}") for i, x in enumerate(xs)], *[F.sum(F.exp(share * x) * share * x).alias(f"e{i}") for i, x in enumerate(xs)]).first()
        return [(row[f"z{i}"], row[f"e{i}"]) for i in range(len(xs))]

    import math

    floor = 0.0
    if most_repetition is not None and head["hi"] > head["lo"]:
        # epochs go as tokens ** (exponent - 1): the least exponent whose extremes stay within the limit, by bisection
        ratio, a, b = math.log(head["hi"] / head["lo"]), 0.0, 1.0
        if ratio > math.log(most_repetition):
            for _ in range(60):
                m = (a + b) / 2
                a, b = (a, m) if (1 - m) * ratio <= math.log(most_repetition) else (m, b)
            floor = b
    x = floor
    if entropy_share is not None:
        ((z, e),) = sums([1.0])
        own = math.log(z) - e / z
        goal, a, b = own + entropy_share * (math.log(max(head["n"], 1)) - own), floor, 1.0
        for _ in range(rounds):
            xs = [a + (b - a) * i / (POINTS - 1) for i in range(POINTS)]
            h = [math.log(z) - e / z for z, e in sums(xs)]  # entropy falls as the exponent grows
            ok = [i for i, v in enumerate(h) if v >= goal - 1e-12]
            if not ok:
                a = b = xs[0]
                break
            if ok[-1] == POINTS - 1:
                a = b = xs[-1]
                break
            a, b = xs[ok[-1]], xs[ok[-1] + 1]
        x = a
    ((z, _),) = sums([x])
    log_norm = math.log(z)
    # weight / share is least for the largest source; the budget leaves it one epoch
    log_scale = log_norm - (x - 1) * math.log(head["hi"] / head["all"])
    return Mix(x, int(head["all"]), log_norm, log_scale)


def mixed(docs: DataFrame, entropy_share: float | None = None, most_repetition: float | None = 1.25, blocks: int = 1024, seed: int = 17) -> tuple[DataFrame, tuple[str, str, str, str]]:
    """docs with each row as often as its source's epochs take it, and the names of the columns with its tokens, epoch (from 0), block and the block's place in the epoch (from 0)."""
    src, n, tot, ep, block, epochs, place = (free_name(docs.columns, x) for x in ("mx_src", "mx_tokens", "mx_total", "mx_epoch", "mx_block", "mx_epochs", "mx_place"))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    own_block = F.pmod(F.xxhash64(*[F.col(c) for c in ("doc_id", "text")], F.lit(seed)), F.lit(blocks)).cast("int")
    keyed = docs.withColumns({src: source, n: tokens(F.col("text")), block: own_block})
    per_block = written(keyed.groupBy(src, block).agg(F.sum(n).alias("t")), "mix-blocks")
    totals = written(per_block.groupBy(src).agg(F.sum("t").alias("src_tokens")), "mix-sources")
    mix = choose_exponent(totals, entropy_share, most_repetition)
    rate = F.exp((mix.exponent - 1) * F.log(F.col("src_tokens") / F.lit(float(max(mix.total, 1)))) - mix.log_norm + mix.log_scale)
    plan = totals.select(src, F.col("src_tokens").alias(tot), F.round(rate, 9).alias(epochs))
    last = F.floor(epochs).cast("int")
    each = per_block.join(plan, src).withColumn(ep, F.explode(F.sequence(F.lit(0), last)))
    order = Window.partitionBy(src, ep).orderBy(F.xxhash64(src, ep, block, F.lit(seed)), block)  # `blocks` rows a group
    before = F.coalesce(F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = (F.col(ep) < last) | (before + F.col("t") / 2 <= (F.col(epochs) - last) * F.col(tot)) & (F.col(epochs) > last)
    chosen = free_name(docs.columns, "mx_chosen")
    side = written(each.withColumns({place: F.row_number().over(order) - 1, chosen: taken}).where(chosen).select(src, block, ep, place), "mix-taken")
    if side.count() <= 500_000:
        side = F.broadcast(side)
    out = keyed.join(side, [src, block])
    return out.select(*docs.columns, F.col(n), F.col(ep), F.col(block), F.col(place)), (n, ep, block, place)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs, rows repeated as their source's weight asks."""
    return mixed(docs, **how)[0].select(*docs.columns)


def mixing_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block and place of every row of the mixture."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    out, (n, ep, block, place) = mixed(slim, **how)
    return out.select("doc_id", "source", F.col(n).alias("n_tokens"), F.col(ep).alias("epoch"), F.col(block).alias("block"), F.col(place).cast("int").alias("place"))

"""Text functions as Column expressions (JVM side), except where a docstring says Arrow.

Nulls: functions of one text give null for null; metrics treat a null text as empty.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

ARTICLES = ("a", "an", "the")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends (trim() only knows spaces)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """White-space tokens."""
    return F.filter(F.split(col(c), r"\s+"), lambda t: t != "")


def tokens(c: Column | str) -> Column:
    """Lower-cased white-space tokens, punctuation kept: the tokens of sparse retrieval."""
    return words(F.lower(col(c)))


def answer_tokens(c: Column | str) -> Column:
    """Tokens of an answer: lower case, no ASCII punctuation, no articles."""
    bare = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), string.punctuation, "")
    return F.filter(words(bare), lambda t: ~t.isin(*ARTICLES))


def normalised(c: Column | str) -> Column:
    return F.array_join(answer_tokens(c), " ")


def exact_match(prediction: Column | str, truth: Column | str) -> Column:
    return (normalised(prediction) == normalised(truth)).cast("double")


def token_f1(prediction: Column | str, truth: Column | str) -> Column:
    """Multiset overlap of answer tokens: 2 * overlap / (both lengths); 0 if either side is empty.

    The tokens of both sides are sorted together, each prediction token before
    its equals of the truth; one fold over them pairs equals, so cost is n log n.
    """

    def sided(xs: Column, side: int) -> Column:
        return F.transform(xs, lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))

    def paired(s: Column, x: Column) -> Column:
        same = s["t"] == x["t"]
        first = x["side"] == 0
        meets = ~first & same & (s["spare"] > 0)
        spare = F.when(first, F.when(same, s["spare"] + 1).otherwise(F.lit(1))).when(meets, s["spare"] - 1).otherwise(s["spare"])
        return F.struct(F.when(first, x["t"]).otherwise(s["t"]).alias("t"), spare.alias("spare"), (s["both"] + F.when(meets, 1).otherwise(0)).alias("both"))

    def score(p: Column) -> Column:
        a, b = p["a"], p["b"]
        none = F.struct(F.lit("").alias("t"), F.lit(0).alias("spare"), F.lit(0).alias("both"))
        both = F.aggregate(F.sort_array(F.concat(sided(a, 0), sided(b, 1))), none, paired, lambda s: s["both"])
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))

    return let(F.struct(answer_tokens(prediction).alias("a"), answer_tokens(truth).alias("b")), score)


def best_over_truths(metric, prediction: Column | str, truths: Column | str) -> Column:
    """The largest value of metric over an array of accepted answers; 0 for none."""
    return F.coalesce(F.array_max(F.transform(col(truths), lambda t: metric(prediction, t))), F.lit(0.0))


def rouge_words(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def long_words(c: Column | str) -> Column:
    """Distinct lower-cased words of four characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]{4,}"), 0))


def word_overlap(answer: Column | str, contexts: Column | str) -> Column:
    """Share of the answer's long words that any of the contexts (an array) has."""
    a, c = long_words(answer), F.array_distinct(F.flatten(F.transform(col(contexts), long_words)))
    return F.size(F.array_intersect(a, F.coalesce(c, F.array().cast("array<string>")))) / F.greatest(F.size(a), F.lit(1)).cast("double")


def contributing_contexts(answer: Column | str, contexts: Column | str, above: float = 0.05) -> Column:
    """How many contexts hold more than a share `above` of the answer's long words."""
    a = long_words(answer)
    return F.size(F.filter(col(contexts), lambda c: F.size(F.array_intersect(a, long_words(c))) / F.greatest(F.size(a), F.lit(1)) > above))


def token_estimate(c: Column | str) -> Column:
    """Tokens of a text, about 1.3 a word, at least 1."""
    return F.greatest(F.lit(1), (F.size(words(F.coalesce(col(c), F.lit("")))) * F.lit(1.3)).cast("int"))


def preview(c: Column | str, length: int) -> Column:
    return F.when(F.length(col(c)) > length, F.concat(F.substring(col(c), 1, length), F.lit("..."))).otherwise(col(c))


def sentences(c: Column | str) -> Column:
    """Split after . ! ? before white space and a capital."""
    return F.split(col(c), r"(?<=[.!?])\s+(?=[A-Z])")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine with the norms written out; 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def supporting_recall(gold: Column | str, found: Column | str) -> Column:
    """Share of distinct gold titles among the found ones; 1 without gold."""
    g = F.array_distinct(col(gold))
    return F.when(F.size(g) == 0, 1.0).otherwise(F.size(F.array_intersect(g, col(found))) / F.size(g))


def kappa_band(k: Column | str) -> Column:
    """The usual bands of agreement."""
    k = col(k)
    return F.when(k < 0, "none").when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("almost perfect")


def yes_no(c: Column | str) -> Column:
    """A yes/no answer: false only for a "no" without a "yes"."""
    t = F.lower(col(c))
    return ~(t.contains("no") & ~t.contains("yes"))


def numbered(documents: Column | str, most: int = 500) -> Column:
    """An array of texts as a numbered list, each cut to `most` characters."""
    return F.array_join(F.transform(col(documents), lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(d, 1, most))), "\n")


def context_block(documents: Column | str, most: int = 5) -> Column:
    """The first documents as "[i] text", a blank line between."""
    return F.array_join(F.transform(F.slice(col(documents), 1, most), lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d)), "\n\n")


def fill_template(template: str, **parts: Column) -> Column:
    """A template's {names} filled with columns."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def grades(response: Column | str, expected: Column | str) -> Column:
    """Booleans from a grader's response.

    The whole response as JSON, then the first JSON object with "grades" in it,
    then true/false words, each only if the number fits; otherwise all true.
    """
    r, n = strip(response), col(expected)
    schema = "grades array<boolean>"

    def fits(xs: Column) -> Column:
        return F.when(F.size(xs) == n, xs)

    first = F.from_json(r, schema)["grades"]
    inner = F.from_json(F.regexp_extract(r, r'\{[^{}]*"grades"\s*:\s*\[[^\]]*\][^{}]*\}', 0), schema)["grades"]
    said = F.transform(F.regexp_extract_all(F.lower(r), F.lit(r"\b(true|false)\b"), 1), lambda x: x == "true")
    return F.coalesce(fits(first), fits(inner), fits(said), F.array_repeat(F.lit(True), n))


def tool_call(payload: Column | str, schema: str) -> Column:
    """A tool call's arguments as a struct; null fields where they don't parse."""
    return F.from_json(col(payload), schema)


def confident_relevance(payload: Column | str, least: float = 0.6) -> Column:
    p = tool_call(payload, "relevant boolean, confidence double, reason string")
    return F.coalesce(p["relevant"] & (p["confidence"] >= least), F.lit(False))


#: Fixed values, in the order in which they are applied.
STOP_PHRASES = (
    "Based on the context", "Based on the provided", "According to the context", "Human:", "Question:", "Can you tell me", "Given the",
    "This information", "You are an AI", "You are a helpful", "As an AI", "I'm an AI", "Note:", "Additional",
)
REWRITE_PREFIXES = ("Improved query:", "Rewritten query:", "Rewritten:", "Better query:", "Query:", "The rewritten", "You can")
SPEAKERS = ("Human:", "Assistant:", "User:", "System:")
HIGHLIGHT_STOP_WORDS = ("that", "this", "with", "from", "have", "were", "they", "been", "which", "their", "also", "more", "than", "into", "when", "what", "will", "some", "time", "would", "there")


def let(value: Column, use) -> Column:
    """use(value) with value worked out once: expressions that name a column several times would otherwise double at every step."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_answer(c: Column | str) -> Column:
    """A generated answer without prefixes, continuations and repeated sentences.

    Sentences count as repeated when the characters they share with a kept one
    are over 0.8 of the longer one's length, so only very short ones are hit.
    """
    a = strip(F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), "(?i)^answer:", ""))
    for phrase in ("\n\n", *STOP_PHRASES):  # what stands before each phrase
        a = strip(F.substring_index(a, phrase, 1))

    def letters(s: Column) -> Column:
        return F.replace(F.lower(s), F.lit(" "), F.lit(""))

    def chars(s: Column) -> Column:
        return F.array_distinct(F.filter(F.split(s, ""), lambda x: x != ""))

    def add(kept: Column, s: Column) -> Column:
        same = F.exists(kept, lambda k: F.size(F.array_intersect(chars(letters(k)), chars(letters(s)))) / F.greatest(F.length(letters(k)), F.length(letters(s))) > 0.8)
        return F.when(same, kept).otherwise(F.concat(kept, F.array(s)))

    def without_repeats(a: Column) -> Column:
        parts = F.transform(F.filter(F.transform(F.split(a, r"\."), strip), lambda s: s != ""), lambda s: F.concat(s, F.lit(".")))
        return let(parts, lambda p: F.when(F.size(p) > 1, F.array_join(F.aggregate(p, F.array().cast("array<string>"), add), " ")).otherwise(a))

    def without_stub(a: Column) -> Column:
        w = words(a)
        return F.when(a.rlike(r"(no|no\.|Given|This)$") & (F.size(w) > 3), F.array_join(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), " ")).otherwise(a)

    return strip(let(let(a, without_repeats), without_stub))


def clean_rewrite(response: Column | str, query: Column | str) -> Column:
    """A rewritten query from a model's response, or the query itself if nothing usable is left."""
    q = col(query)
    r = strip(F.substring_index(strip(F.coalesce(col(response), F.lit(""))), "\n", 1))
    for p in REWRITE_PREFIXES:
        r = strip(F.regexp_replace(r, f"(?i)^{re.escape(p)}", ""))
    for mark in ('"', "'"):
        r = strip(F.regexp_replace(r, f"(?s)^{mark}(.*){mark}$", "$1"))
    r = strip(F.regexp_replace(r, "```[a-z]*", ""))
    for s in SPEAKERS:  # a speaker's name at the very start stays
        r = strip(F.regexp_replace(r, f"(?s)^(?!{s})(.*?){s}.*$", "$1"))
    r = strip(F.regexp_replace(r, r"(?s)^([^?]*\?).*$", "$1"))

    def short(r: Column) -> Column:
        most = F.greatest(F.length(q) * 2, F.lit(60))
        head = F.substring(r, F.lit(1), most)
        return F.when(F.length(r) > most, F.regexp_replace(head, r"(?s)(.)\x20[^\x20]*$", "$1")).otherwise(r)

    return let(let(r, short), lambda r: F.when(F.length(r) < 3, q).otherwise(r))


def highlighted(chunk: Column | str, answer: Column | str, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """chunk with the answer's long words (stop words apart) marked, by one regular expression a row."""
    marked = F.filter(long_words(answer), lambda w: ~w.isin(*HIGHLIGHT_STOP_WORDS))
    pattern = F.concat(F.lit(r"(?iU)\b("), F.array_join(marked, "|"), F.lit(r")\b"))
    return F.when(F.size(marked) == 0, col(chunk)).otherwise(F.regexp_replace(col(chunk), pattern, F.lit(f"{opening}$1{closing}")))

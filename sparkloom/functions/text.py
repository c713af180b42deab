"""Text signals as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import Lexicon

SPACE_ENDS = r"(?U)^\s+|\s+$"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def joined(*parts: Column) -> Column:
    """Parts with a space between; a null part is empty."""
    return F.concat_ws(" ", *(text_or_empty(p) for p in parts))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_ENDS, "")


def first_line(c: Column, limit: int = 200) -> Column:
    return F.substring(stripped(F.split_part(text_or_empty(c), F.lit("\n"), F.lit(1))), 1, limit)


def hits(c: Column, pattern: str) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(pattern))


def flag(c: Column, pattern: str) -> Column:
    return text_or_empty(c).rlike(pattern)


def numbers(c: Column, pattern: str, low: float | None = None, high: float | None = None, below: float | None = None) -> Column:
    """Captured grouped numbers as doubles, their separators dropped, in a band."""
    found = F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, "[.,]", "").cast("double"))
    if low is not None:
        found = F.filter(found, lambda x: x.between(low, high))
    return F.filter(found, lambda x: x < below) if below is not None else found


def split_numbers(c: Column, pattern: str, low: float, high: float) -> Column:
    """Numbers whose thousands and rest are two groups of the pattern, as doubles in a band."""
    t = text_or_empty(c)
    whole = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("b"))
    return F.filter(F.transform(whole, lambda x: F.concat(x["a"], x["b"]).cast("double")), lambda x: x.between(low, high))


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def array_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def direction_score(up: Column, down: Column) -> Column:
    return (up - down) / (up + down + 1)


def body_direction(c: Column, lexicon: Lexicon, least: int = 50) -> Column:
    """Direction score of a body; null if it is shorter than `least` characters."""
    return F.when(F.length(text_or_empty(c)) >= least, direction_score(hits(c, lexicon.up), hits(c, lexicon.down)))


def entropy(*shares: Column) -> Column:
    """-sum p log2 p over the positive shares, which need not sum to 1."""
    positive = F.filter(F.array(*shares), lambda p: p > 0)
    return F.abs(F.aggregate(positive, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once a row: an expression that a lambda repeats is evaluated at each repetition."""
    return F.get(F.transform(F.array(value), use), 0)


def ngrams(c: Column, n: int = 3) -> Column:
    """Runs of n lower-case words; those with a digit are left out."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text_or_empty(c)), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda w: w != "")
    none = F.array().cast("array<string>")

    def grams(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)

    return F.filter(bound(words, grams), lambda g: ~g.rlike(r"(?U)\d"))


def paragraph_score(p: Column, lexicon: Lexicon) -> Column:
    low = F.lower(p)
    score = F.lit(0)
    for weight, terms in ((3, lexicon.high_terms), (2, lexicon.medium_terms), (1, lexicon.low_terms)):
        for t in terms:
            score = score + F.when(low.contains(t.lower()), weight).otherwise(0)
    return score + F.when(p.rlike(lexicon.paragraph_price), 3).otherwise(0)


def smart_truncate(c: Column, lexicon: Lexicon, budget: int = 1500, least: int = 50, tail: int = 100) -> Column:
    """The best-scored paragraphs of a text, within a budget of characters.

    Short texts stay. Paragraphs of more than 20 characters without noise are scored; those above 0 are taken by
    score, then place. The first that overflows gives its beginning if more than `tail` characters are left, and ends the choice.
    Without a scored paragraph the text's beginning stands.
    """
    text = text_or_empty(c)
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        room = F.lit(budget) - s["used"]
        fits = F.length(x["p"]) <= room
        piece = F.when(fits, F.array(x["p"])).when(room > tail, F.array(F.substring(x["p"], F.lit(1), room))).otherwise(F.array().cast("array<string>"))
        grown = F.struct((s["used"] + F.length(x["p"])).alias("used"), (~fits).alias("over"), F.concat(s["out"], piece).alias("out"))
        return F.when(s["over"], s).otherwise(grown)

    def chosen(kept: Column) -> Column:
        scored = F.transform(kept, lambda p, i: F.struct((-paragraph_score(p, lexicon)).alias("rank"), i.alias("i"), p.alias("p")))
        return bound(F.array_sort(F.filter(scored, lambda s: s["rank"] < 0)), lambda ranked: F.when(F.size(ranked) > 0, F.array_join(F.aggregate(ranked, start, step)["out"], "\n")))

    kept = F.filter(F.transform(F.split(text, "\n"), stripped), lambda p: (F.length(p) > 20) & ~p.rlike(lexicon.paragraph_noise))
    return F.when(F.length(text) < least, text).otherwise(F.coalesce(bound(kept, chosen), F.substring(text, 1, budget)))


def unfenced(c: Column) -> Column:
    """The content of a Markdown fence, its language tag dropped; other texts as they are."""
    inner = F.regexp_replace(F.split_part(c, F.lit("```"), F.lit(2)), "^json", "")
    return stripped(F.when(stripped(c).startswith("```"), inner).otherwise(c))


def url_domain(c: Column) -> Column:
    return F.when(c.contains("://"), F.split_part(c, F.lit("/"), F.lit(3))).otherwise("")


def masked_key(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(4)), F.lit("..."), F.right(c, F.lit(4)))


def excluding(c: Column, sites: list[str]) -> Column:
    """A search query with sites left out."""
    return F.concat(c, *(F.lit(f" -site:{s}") for s in sites))


def consistency(direction: Column, change: Column) -> Column:
    """Whether a stated direction and a signed change agree."""
    fine = ((direction == "UP") & (change > 0)) | ((direction == "DOWN") & (change < 0)) | ((direction == "STABLE") & (change == 0)) | (direction == "MIXED")
    return F.when(F.coalesce(fine, F.lit(False)), "OK").otherwise("MISMATCH")

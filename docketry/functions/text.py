"""Text scalars and fuzzy similarity as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that say nothing about which matter a title names.
STOPWORDS = """
v vs versus the of and or a an to for in re by its through
ors anr others another etc
state union india govt government
ltd pvt co company corporation
case judgment judgement matter
justice retd dr mr mrs ms smt shri sri
""".split()

TOKEN_MATCH = 0.45  # least similarity of two spellings of a word
SKELETON_MATCH = 0.6  # similarity given to words with one consonant skeleton

_FOLDED = [range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F)]
_EXPANDED = "ﬀﬁﬂﬃﬄﬅﬆ¼½¾…™"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with the value worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ascii(char: str) -> str:
    return unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()


def fold_ascii(text: Column) -> Column:
    """Latin letters without their accents, ligatures spelled out, everything else beyond ASCII deleted."""
    single = [(chr(c), _ascii(chr(c))) for r in _FOLDED for c in r if len(_ascii(chr(c))) == 1]
    out = F.translate(text, "".join(a for a, _ in single), "".join(b for _, b in single))
    for char in _EXPANDED:
        out = F.replace(out, F.lit(char), F.lit(_ascii(char)))
    out = F.regexp_replace(out, "[^\\x00-\\x7F]", "")
    return F.when(text.rlike("[^\\x00-\\x7F]"), out).otherwise(text)


@F.pandas_udf(StringType())
def fold_ascii_exact(text: pd.Series) -> pd.Series:
    """The same by full compatibility decomposition, for scripts beyond the Latin ones."""
    return text.map(_ascii, na_action="ignore")


def normalize(text: Column, fold=fold_ascii) -> Column:  # noqa: ANN001
    """Lower-case ASCII words with single spaces between; & is a word."""
    spelled = F.replace(F.lower(fold(text)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def distinctive(words: Column) -> Column:
    """Of tokens, those that tell matters apart: no stopwords, numbers or initials; order and repeats stay."""
    return F.filter(words, lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]+$") & ~t.isin(STOPWORDS))


def distinctive_tokens(text: Column) -> Column:
    return distinctive(tokens(text))


def word_trigrams(word: Column) -> Column:
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3))))


def trigrams(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(tokens(text), word_trigrams)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; 0 if either array is empty."""
    ratio = lambda n: F.when((n["a"] == 0) | (n["b"] == 0), F.lit(0.0)).otherwise(n["both"] / (n["a"] + n["b"] - n["both"]))
    sizes = lambda p: F.struct(F.size(p["a"]).alias("a"), F.size(p["b"]).alias("b"), F.size(F.array_intersect(p["a"], p["b"])).alias("both"))
    return let(let(F.struct(a.alias("a"), b.alias("b")), sizes), ratio)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def skeleton(word: Column) -> Column:
    """w is v; vowels, y and h go; then equal neighbours are one."""
    return F.regexp_replace(F.translate(F.replace(word, F.lit("w"), F.lit("v")), "aeiouyh", ""), "(.)\\1+", "$1")


def word_similarity(a: Column, b: Column) -> Column:
    parts = F.struct(jaccard(word_trigrams(a), word_trigrams(b)).alias("plain"), skeleton(a).alias("a"), skeleton(b).alias("b"))
    alike = lambda p: (F.length(p["a"]) >= 3) & (p["a"] == p["b"])
    return let(parts, lambda p: F.when((p["plain"] < SKELETON_MATCH) & alike(p), F.lit(SKELETON_MATCH)).otherwise(p["plain"]))


def with_joined_pairs(words: Column) -> Column:
    """The words, then each two neighbours written as one."""
    n = F.size(words)
    heads = F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0)))
    tails = F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.concat(words, F.zip_with(heads, tails, lambda x, y: F.concat(x, y)))


def best_token_scores(source: Column, target: Column) -> Column:
    """For each source word the best similarity to a target word or joined pair; zeros without target words."""
    best = lambda pool: F.transform(source, lambda s: F.coalesce(F.array_max(F.transform(pool, lambda t: word_similarity(s, t))), F.lit(0.0)))
    return let(target, lambda words: let(with_joined_pairs(words), best))


def coverage(source: Column, target: Column, threshold: float = TOKEN_MATCH) -> Column:
    """Share of source words found among the target's; 0 without source words."""
    share = lambda scores: F.when(F.size(scores) == 0, F.lit(0.0)).otherwise(F.size(F.filter(scores, lambda s: s >= threshold)) / F.size(scores))
    return let(best_token_scores(source, target), share)


def tokens_match(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Whether the shorter of two token arrays (the first, if alike) is covered by the longer."""
    ordered = lambda p: F.when(F.size(p["a"]) <= F.size(p["b"]), p).otherwise(F.struct(p["b"].alias("a"), p["a"].alias("b")))
    covered = lambda p: (F.size(p["a"]) > 0) & (coverage(p["a"], p["b"]) >= threshold)
    return let(let(F.struct(a.alias("a"), b.alias("b")), ordered), covered)


def titles_match(a: Column, b: Column, threshold: float = 0.8) -> Column:
    return tokens_match(distinctive_tokens(a), distinctive_tokens(b), threshold)


def normalize_for_quotes(text: Column) -> Column:
    """Straight quotes, plain dashes, three dots, no soft hyphens, single blanks; case stays."""
    plain = F.translate(text, "“”‘’–—­", "\"\"''--")
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("…"), F.lit("...")), "\\s+", " "))


def quotations(text: Column) -> Column:
    """What stands between double quotes."""
    return F.regexp_extract_all(normalize_for_quotes(text), F.lit('"([^"]+)"'), 1)


def quote_in(quote: Column, passage: Column) -> Column:
    """Whether the pieces of a quotation around ellipses occur in the passage in order, each as early as it can.

    Both are taken as normalize_for_quotes gives them.
    """
    pieces = F.filter(F.split(quote, "\\s*(?:\\[\\s*\\.\\.\\.\\s*\\]|\\.\\.\\.)\\s*"), lambda p: F.trim(p) != "")
    step = lambda at, piece: F.when(at == 0, F.lit(0)).otherwise(_after(piece, passage, at))
    return F.aggregate(pieces, F.lit(1), step) > 0


def _after(piece: Column, passage: Column, at: Column) -> Column:
    found = F.call_function("locate", F.trim(piece), passage, at)
    return F.when(found == 0, F.lit(0)).otherwise(found + F.length(F.trim(piece)))

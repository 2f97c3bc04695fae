"""Quality rules: reasons by first match, and reasons as bits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T


@dataclass(frozen=True)
class Thresholds:
    """The limits of the rules."""

    min_tokens: int = 15
    max_tokens: int = 100_000
    min_mean_word: float = 2.5
    max_mean_word: float = 12.0
    min_text_share: float = 0.60
    max_digit_share: float = 0.30
    max_repeated_lines: float = 0.30
    min_latin: float = 0.70
    min_stopwords: float = 0.06


#: Stricter shares, stricter language, and both.
SHARES = Thresholds(min_text_share=0.70, max_digit_share=0.20)
QA_STRICT = Thresholds(min_latin=0.85, min_stopwords=0.10)
STRICT = Thresholds(min_text_share=0.70, max_digit_share=0.20, min_latin=0.85, min_stopwords=0.10)
# Public collections of English prose whose language is judged more strictly; a user's own sources are given as an argument.
LANGUAGE_STRICT = ("fineweb_edu", "c4", "cosmopedia", "slimpajama", "ebooks")

#: Classes of sources by the head of their id.
SOURCE_CLASS = {"code": "code", "cli": "code", "qa": "qa", "forum": "qa", "lit": "verse"}


def source_class(source: Column) -> Column:
    """code, qa, verse or prose, from the source's name up to the first underscore."""
    head = F.split_part(F.lower(F.trim(F.coalesce(source, F.lit("")))), F.lit("_"), F.lit(1))
    out = F.lit("prose")
    for k, v in SOURCE_CLASS.items():
        out = F.when(head == k, v).otherwise(out)
    return out


def assess(c: Column, t: Thresholds = Thresholds()) -> Column:
    """The first rule that a text breaks, or keep. Null counts as an empty text (too_short)."""
    c = F.coalesce(c, F.lit(""))
    chars = F.length(c)
    # tokens are cut once; their number and total length decide the first four rules
    measured = T.let(T.tokens(c), lambda w: F.struct(F.size(w).alias("n"), T.ratio(F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)), F.size(w)).alias("mean")))
    return T.let(measured, lambda m: (
        F.when(m["n"] < t.min_tokens, "too_short")
        .when(m["n"] > t.max_tokens, "too_long")
        .when(m["mean"] < t.min_mean_word, "mean_word_length_low")
        .when(m["mean"] > t.max_mean_word, "mean_word_length_high")
        .when(T.ratio(T.count_match(c, r"[\p{L} \t\r\n]"), chars) < t.min_text_share, "symbol_soup")
        .when(T.ratio(T.count_match(c, r"[0-9]"), chars) > t.max_digit_share, "mostly_digits")
        .when(T.repeated_line_share(c) > t.max_repeated_lines, "repeated_lines")
        .when(T.latin_ratio(c) < t.min_latin, "not_latin_script")
        .when(T.stopword_ratio(c) < t.min_stopwords, "not_english_prose")
        .otherwise("keep")
    ))


def strict_assess(c: Column, source: Column, strict: tuple[str, ...] = LANGUAGE_STRICT) -> Column:
    """assess with stricter limits: of shares for all but question threads, of language for the sources named in ``strict``."""
    qa, named = source_class(source) == "qa", F.coalesce(F.lower(F.trim(source)).isin(*strict), F.lit(False))
    return F.when(qa & named, assess(c, QA_STRICT)).when(qa, assess(c)).when(named, assess(c, STRICT)).otherwise(assess(c, SHARES))


def tally(df: DataFrame, reason: Column, enabled: bool = True) -> DataFrame:
    """Rows per source and reason; with the filter off, everything is kept."""
    return df.groupBy("source", (reason if enabled else F.lit("keep")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: Runs of end marks, or fifteen and more of one other symbol; dashes, dots and the like are ordinary typography.
SPAM_SYMBOLS = "$%&#@^~|\\<>{}[]"
SPAM_PUNCT = r"[!?]{5,}|" + "|".join(rf"\{s}{{15,}}" for s in SPAM_SYMBOLS)


def structural_rules(c: Column, source: Column) -> dict[str, Column]:
    """Eight rules on the shape of a text, each a boolean; code is exempt from all, questions from the first four."""
    c = F.coalesce(c, F.lit(""))
    kind = source_class(source)
    tok = T.tokens(c)
    n = F.size(tok)
    low = F.transform(tok, lambda x: F.lower(x))
    urls = F.regexp_count(c, F.lit("https?://"))
    latex = F.regexp_count(c, F.lit(r"\\[a-z]+"))
    upper = F.size(F.filter(tok, lambda x: x.rlike("^[A-Z]{2,}[^a-z]*$")))
    prose_only = ~kind.isin("code", "qa")
    no_code = kind != "code"
    return {
        "nonprose_layout": prose_only & (kind != "verse") & (n >= 30) & ~c.contains("```") & (T.layout_short_share(c) >= 0.5),
        "nonprose_tail": prose_only & (n >= 200) & c.rlike("[a-z]$") & ~F.substring(c, -200, 200).rlike("[.!?…]"),
        "no_sentence_punct": prose_only & (n >= 100) & ~c.rlike("[.!?…]"),
        "link_farm": prose_only & (urls >= 8) & (urls * 20 >= n),
        "low_lexical_diversity": no_code & (n >= 120) & (T.ratio(F.size(F.array_distinct(low)), n) <= 0.22) & (latex < 10),
        "all_caps": no_code & (n >= 40) & (T.ratio(upper, n) >= 0.5),
        "replacement_chars": no_code & (T.count_match(c, "�") >= 3),
        "spam_punctuation": no_code & c.rlike(SPAM_PUNCT),
    }


#: Bits of the first pass, in order.
PASS1 = ["corrupt_or_empty", "too_short", "too_long", "mean_word_length_low", "mean_word_length_high", "symbol_soup", "mostly_digits", "repeated_lines", "not_latin_script", "not_english_prose", "boilerplate", "ngram_spam", "duplicate"]
#: Bits of the second pass.
PASS2 = ["nonprose_layout", "nonprose_tail", "no_sentence_punct", "link_farm", "low_lexical_diversity", "all_caps", "replacement_chars", "spam_punctuation", "byte_fallback", "fertility", "near_duplicate", "corrupt_or_empty"]


def bitmask(names: list[str], flags: dict[str, Column]) -> Column:
    """Flags packed into a whole number, bit k for names[k]; null flags count as false."""
    out = F.lit(0)
    for k, name in enumerate(names):
        if name in flags:
            out = out + F.when(flags[name], F.lit(1 << k)).otherwise(0)
    return out.cast("int")


def decode_bits(names: list[str], bits: Column) -> Column:
    """The names of the bits that are set, in order."""
    return F.filter(F.array(*[F.when(F.expr("1 = 1") & (bits.bitwiseAND(1 << k) != 0), n) for k, n in enumerate(names)]), lambda x: x.isNotNull())


def pass1_bits(c: Column, source: Column, duplicate: Column | None = None, strict: tuple[str, ...] = LANGUAGE_STRICT) -> Column:
    """Reasons of the first pass: code skips the prose rules, questions have only n-gram spam and duplicates."""
    kind = source_class(source)
    empty = F.coalesce(T.strip(c) == "", F.lit(True))
    prose = ~kind.isin("code", "qa")
    # the reason is computed once and turned into its bit
    bit = lambda r: reduce(lambda x, n: F.when(r == PASS1[n], F.lit(1 << n)).otherwise(x), range(1, 10), F.lit(0))
    first = F.when(prose & ~empty, T.let(strict_assess(c, source, strict), bit)).otherwise(0)
    flags = {"corrupt_or_empty": empty, "boilerplate": prose & ~empty & T.boilerplate_phrase_hit(c), "ngram_spam": (kind != "code") & ~empty & T.ngram_spam(c)}
    if duplicate is not None:
        flags["duplicate"] = duplicate
    return (bitmask(PASS1, flags) + F.coalesce(first, F.lit(0))).cast("int")

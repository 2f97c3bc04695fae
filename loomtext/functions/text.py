"""Column expressions over text: null stays null unless a docstring says otherwise.

Lengths are code points. Only ASCII white space is trimmed, so that results do not depend on
the regular-expression engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.lexicon import ALT_PLACEHOLDER, BOILERPLATE_LINES, BOILERPLATE_PHRASES, STOPWORDS

SPACE = r"[ \t\r\n\f\x0b]"


def strip(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Lambdas evaluate a captured expression again for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def count_match(c: Column, pattern: str) -> Column:
    """Number of code points of ``c`` that match a one-character class; runs go as a whole."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{pattern}+", ""))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.when(whole.isNotNull(), F.lit(0.0)))


# ------------------------------------------------------------------ cleaning
def blank_alt(c: Column, placeholder: str = ALT_PLACEHOLDER) -> Column:
    """Markdown images whose alternative text holds the placeholder keep the target and lose the text."""
    return F.regexp_replace(c, rf"(?i)(!\[)[^\]]*{placeholder}[^\]]*(\])", "$1$2")


def normalize_whitespace(c: Column) -> Column:
    """CR LF and CR become LF; three and more blanks before a line end go; three and more line ends become two; stripped."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]{3,}\n", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def is_boilerplate(line: Column, patterns: list[str] = BOILERPLATE_LINES) -> Column:
    """A blank line, or one that begins as page furniture does."""
    s = strip(line)
    return (s == "") | s.rlike(f"^(?:{'|'.join(patterns)})")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def drop_boilerplate(c: Column) -> Column:
    return F.array_join(F.filter(lines(c), lambda x: ~is_boilerplate(x)), "\n")


def join_record_lines(c: Column) -> Column:
    """Every line trimmed, empty ones dropped."""
    return F.array_join(F.filter(F.transform(lines(c), strip), lambda x: x != ""), "\n")


#: Two private-use code points and the word marker of the tokenizer.
ESC, ESC_MARK, MARKER = "\ue000", "\ue001", "\u2581"


def escape_markers(c: Column) -> Column:
    """ESC is doubled, the word marker becomes (ESC, ESC_MARK); the output of the second step holds no marker to escape again."""
    return F.replace(F.replace(c, F.lit(ESC), F.lit(ESC * 2)), F.lit(MARKER), F.lit(ESC + ESC_MARK))


def unescape_markers(c: Column) -> Column:
    """The inverse, in one pass from the left: cut at doubled ESC, decode the pieces, put single ESC between them."""
    pieces = F.transform(F.split(c, ESC * 2), lambda p: F.replace(p, F.lit(ESC + ESC_MARK), F.lit(MARKER)))
    return F.array_join(pieces, ESC)


def strip_html(c: Column) -> Column:
    """Scripts and styles, then tags, become blanks; common entities are decoded once, last."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    return decode_entities(c)


# Entities decoded without Python; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def decode_entities(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), c)


def folded(c: Column) -> Column:
    """Lower case, without punctuation, white space collapsed: what near duplicates share."""
    c = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_ \t\r\n]+", "")
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def exact_key(c: Column) -> Column:
    return F.sha2(c, 256)


def folded_key(c: Column) -> Column:
    return F.sha2(folded(c), 256)


# ------------------------------------------------------------------ quality
def tokens(c: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_extract_all(c, F.lit(r"[^ \t\r\n\f\x0b]+"), F.lit(0))


def latin_ratio(c: Column) -> Column:
    """ASCII letters among all letters; 0 without letters."""
    return ratio(count_match(c, r"[A-Za-z]"), count_match(c, r"\p{L}"))


def plain_words(c: Column) -> Column:
    """Lower-case words of ASCII letters and apostrophes, of two characters and more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z']+"), F.lit(0)), lambda w: F.length(w) >= 2)


def stopword_ratio(c: Column) -> Column:
    return let(plain_words(c), lambda w: ratio(F.size(F.filter(w, lambda x: x.isin(STOPWORDS))), F.size(w)))


def repeated_line_share(c: Column) -> Column:
    """Share of non-blank lines that repeat an earlier one, 0 for up to four lines."""
    kept = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    return let(kept, lambda a: F.when(F.size(a) > 4, 1 - F.size(F.array_distinct(a)) / F.size(a)).otherwise(0.0))


def boilerplate_hits(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a + b, [low.contains(p).cast("int") for p in BOILERPLATE_PHRASES])


def boilerplate_phrase_hit(c: Column) -> Column:
    n = boilerplate_hits(c)
    return (n >= 2) | ((n >= 1) & (F.length(c) < 600))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by a blank; an empty array for fewer words or null."""

    def build(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<string>"))

    return let(words, build)


def max_count(values: Column) -> Column:
    """How often the most frequent value of an array occurs: one pass over the sorted array, no shuffle."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(values), start, step, lambda a: a["best"])


def spam_words(c: Column) -> Column:
    """Runs of ASCII letters and apostrophes, lower-cased."""
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z']+"), F.lit(0)), F.lower)


def ngram_spam(c: Column, min_words: int = 40, threshold: float = 0.12) -> Column:
    """The most frequent run of four words makes up more than the threshold of all such runs."""
    return let(spam_words(c), lambda t: (F.size(t) >= min_words) & let(ngrams(t, 4), lambda g: ratio(max_count(g), F.size(g)) > threshold))


def layout_short_share(c: Column) -> Column:
    """Share of characters in lines of up to six tokens without an end mark; 0 for fewer than five lines."""
    kept = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    short = lambda a: F.filter(a, lambda x: (F.size(tokens(x)) <= 6) & ~x.rlike(r"[.!?:;…\"')]$"))
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    return let(kept, lambda a: F.when(F.size(a) >= 5, ratio(chars(short(a)), chars(a))).otherwise(0.0))


# ------------------------------------------------------------------ metrics
def metric_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


def tokenize_13a(c: Column) -> Column:
    """The published 13a tokenisation: entities, then punctuation, periods and commas not between digits, dashes after digits."""
    c = F.replace(F.replace(c, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit(""))
    c = F.replace(c, F.lit("\n"), F.lit(" "))
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    c = F.regexp_replace(c, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    c = F.regexp_replace(c, r"([^0-9])([\.,])", "$1 $2 ")
    c = F.regexp_replace(c, r"([\.,])([^0-9])", " $1 $2")
    c = F.regexp_replace(c, r"([0-9])(-)", "$1 $2 ")
    return F.array_join(tokens(c), " ")


def has_loop(c: Column, n: int = 3, times: int = 3) -> Column:
    return max_count(ngrams(metric_words(c), n)) >= times


def novel_word_rate(source: Column, output: Column) -> Column:
    """Share of the output's words that the source lacks; null without words."""
    new = lambda src, out: F.size(F.filter(out, lambda w: ~F.array_contains(src, w))) / F.size(out)
    return let(metric_words(source), lambda src: let(metric_words(output), lambda out: F.when(F.size(out) > 0, new(src, out))))


def length_ratio(source: Column, output: Column) -> Column:
    return F.length(output) / F.greatest(F.length(source), F.lit(1))


def draw(*parts: Column) -> Column:
    """A whole number in [0, 2^60) from a digest: the same on any engine and any partitioning."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    return draw(*parts) / F.lit(float(1 << 60))

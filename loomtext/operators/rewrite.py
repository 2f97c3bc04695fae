"""Rewriting pairs: pieces of lines, the prose test, seeded noise, and framed pairs.

Noise is made so that the original is the one right answer: slips, agreement errors, dropped and doubled words,
lost capitals and stops. Every operator on a word takes the line and a place and gives the changes it would
make there, or nothing; operators are tried in a random order weighted in their favour, and the first that applies is
used, which is the same as a weighted draw among those that apply.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import examples as X
from loomtext.operators.examples import seeded

# Stretches inside prose that noise never touches, the more specific forms first.
PROTECTED = [
    r"`[^`\n]*`",
    r"(?:https?://|ftp://|www\.)\S+",
    r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    r"(?:~|\.{1,2})?/[\w.~+-]+(?:/[\w.~+-]*)*",
    r"<[^<>\n]{1,60}>",
    r"[#@$][\w-]+",
    r"\w+(?:[._-]\w+)+",
    r"[A-Za-z]*\d[\w%]*",
    r"[A-Z]{2,}(?![a-z])",
    r"[a-z]+[A-Z]\w*",
]
PIECE = re.compile(rf"(?P<protected>{'|'.join(PROTECTED)})|(?P<word>[^\W\d_]+(?:['’][^\W\d_]+)*)|(?P<space>[ \t]+)|(?P<punct>.)", re.S)
CODE_START = re.compile(r"^\s*(?:[#>|$\[<;]|```|import |from \S+ import |def |class |return |//|/\*|-- |\{|\}|(?:if|for|while)\s*\(|(?:var|let|const|function) |\w+\s*=\s*\S+$)")
SYMBOLS = frozenset("{}[]<>=|\\;$#%^&*_~`")

# Weights of the operators on words.
WEIGHTS = {"confusable": 4.0, "drop_function_word": 3.0, "typo": 3.0, "case": 2.0, "preposition": 1.5, "drop_apostrophe": 1.5, "double_word": 1.0, "swap_adjacent": 1.0}
# Words that are dropped, and prepositions that stand for one another.
FUNCTION_WORDS = "a an the of to in on at for with by from is are was were be been has have had that which will would".split()
PREPOSITIONS = [["in", "on", "at"], ["to", "for"], ["from", "of"], ["with", "by"], ["into", "onto"], ["about", "over"], ["since", "for"], ["during", "while"]]


@dataclass(frozen=True)
class Profile:
    """A strength: its weight, the range of the rate per word, and how likely a text is all lower case, without marks, or runs sentences together."""

    weight: float
    rate: tuple[float, float]
    lowercase: float
    no_marks: float
    run_on: float


# The strengths.
PROFILES = {"light": Profile(0.35, (0.03, 0.08), 0.05, 0.00, 0.10), "medium": Profile(0.40, (0.08, 0.18), 0.15, 0.10, 0.25), "heavy": Profile(0.25, (0.18, 0.35), 0.40, 0.35, 0.40)}


def grammar_groups() -> list[list[str]]:
    """Groups of forms that writers confuse, made by rules of English grammar.

    Agreement of be, have and do, plain and negated; a possessive and the pronoun with its verb, which sound alike; the article by
    the next sound; demonstratives by number. Lists of words that merely look or sound alike are the user's
    to give (``read_groups``).
    """
    agreement = [("is", "are"), ("was", "were"), ("has", "have"), ("does", "do")]
    sounds = [("its", "it", "'s"), ("your", "you", "'re"), ("their", "they", "'re"), ("whose", "who", "'s")]
    groups = [list(g) for g in agreement] + [[f"{w}n't" for w in g] for g in agreement]
    return groups + [[own, pronoun + verb] for own, pronoun, verb in sounds] + [["a", "an"], ["this", "these"], ["that", "those"]]


def read_groups(lines: Iterable[str]) -> list[list[str]]:
    """Groups from text: one per line, members between commas; lines that are blank or start with # do not count."""
    return [g for x in lines if not x.lstrip().startswith("#") and len(g := [w.strip() for w in x.split(",") if w.strip()]) > 1]


def alternatives(groups: list[list[str]]) -> dict[str, tuple[str, ...]]:
    """word -> the other members of all its groups."""
    out: dict[str, set[str]] = {}
    for g in groups:
        for w in g:
            out.setdefault(w, set()).update(x for x in g if x != w)
    return {w: tuple(sorted(x)) for w, x in out.items()}


def confusion_table(groups: DataFrame, group: str, word: str) -> DataFrame:
    """(word, others): the same over a table of groups of any size."""
    g = groups.select(F.col(group).alias("k"), F.col(word).alias("w")).distinct()
    j = g.alias("a").join(g.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.w") != F.col("b.w")))
    return j.groupBy(F.col("a.w").alias("word")).agg(F.array_sort(F.collect_set("b.w")).alias("others"))


def keyboard() -> dict[str, str]:
    """Letter -> the letters next to it on a QWERTY keyboard: its row, and those that touch it above and below."""
    rows = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]
    place = {c: (r, k + r * 0.5) for r, row in enumerate(rows) for k, c in enumerate(row)}
    return {c: "".join(sorted(d for d, (r2, k2) in place.items() if d != c and abs(r - r2) <= 1 and abs(k - k2) <= 1)) for c, (r, k) in place.items()}


def split_line(line: str) -> list[tuple[str, str]]:
    """(kind, text) pieces that join to the line again."""
    return [(m.lastgroup, m.group()) for m in PIECE.finditer(line)]


def is_prose(line: str, min_words: int = 4) -> bool:
    """The prose test of one line, its words counted as the noise sees them."""
    solid = [c for c in line if not c.isspace()]
    if not solid or not any(map(str.islower, line)) or CODE_START.match(line):
        return False
    return sum(kind == "word" for kind, _ in split_line(line)) >= min_words and sum(map(str.isalpha, solid)) >= 0.6 * len(solid) and sum(c in SYMBOLS for c in solid) <= 0.04 * len(solid)


def is_prose_line(line: Column, min_words: int = 4) -> Column:
    """Lower-case letters, no start of code, enough words, letters over half and few symbols among the non-blanks."""
    from loomtext.functions import text as T

    solid = F.length(F.regexp_replace(line, r"[ \t\r\n]", ""))
    words = F.regexp_count(line, F.lit(r"[A-Za-z][A-Za-z'-]*"))
    letters, symbols = T.count_match(line, r"\p{L}"), T.count_match(line, r"[#$%&*+/<=>@\\^_`{|}~]")
    return line.rlike("[a-z]") & ~line.rlike(r"^[ \t]*([#>|$]|```|import |def |class |//|[{}])") & (words >= min_words) & (T.ratio(letters, solid) >= 0.6) & (T.ratio(symbols, solid) <= 0.04)


class Line:
    """The pieces of a line and what becomes of them; a piece changes once."""

    def __init__(self, line: str):
        pieces = split_line(line)
        self.kind, self.old = [k for k, _ in pieces], [t for _, t in pieces]
        self.new = list(self.old)

    def changed(self, k: int) -> bool:
        return self.new[k] != self.old[k]

    def next_word(self, k: int) -> int | None:
        """The place of the word after ``k`` where one blank separates them."""
        there = k + 2 < len(self.old) and self.old[k + 1] == " " and self.kind[k + 2] == "word"
        return k + 2 if there else None

    def apply(self, changes: dict[int, str]) -> None:
        for k, t in changes.items():
            self.new[k] = t


Changes = dict[int, str]
WordOperator = Callable[[Line, int, random.Random], Changes | None]


def _like(model: str, word: str) -> str:
    """The word with the capitals of the model."""
    return word.upper() if model.isupper() and len(model) > 1 else word[0].upper() + word[1:] if model[0].isupper() else word


def _one_of(table: dict[str, tuple[str, ...]], line: Line, k: int, rng: random.Random) -> Changes | None:
    others = table.get(line.old[k].lower())
    return {k: _like(line.old[k], rng.choice(others))} if others else None


def _without(line: Line, k: int, rng: random.Random) -> Changes | None:
    """The word goes with one of the blanks beside it."""
    if line.old[k].lower() not in FUNCTION_WORDS:
        return None
    blank = next((x for x in (k + 1, k - 1) if 0 <= x < len(line.old) and line.kind[x] == "space"), None)
    return {k: ""} | ({blank: ""} if blank is not None else {})


def _slip(keys: dict[str, str], line: Line, k: int, rng: random.Random) -> Changes | None:
    """One of the slips of a finger that are possible at a place after the first letter: swapped, lost, doubled or neighbouring letters."""
    w = line.old[k]
    if len(w) < 4:
        return None
    at = rng.randrange(1, len(w))
    head, c, tail = w[:at], w[at], w[at + 1 :]
    slips = [head + tail, head + c + c + tail]
    if tail and tail[0] != c:
        slips.append(head + tail[0] + c + tail[1:])
    if near := keys.get(c.lower()):
        slips.append(head + _like(c, rng.choice(near)) + tail)
    return {k: rng.choice(slips)}


def _lost_capital(line: Line, k: int, rng: random.Random) -> Changes | None:
    w = line.old[k]
    return {k: w.lower()} if w[0].isupper() and not w.isupper() else None


def _lost_apostrophe(line: Line, k: int, rng: random.Random) -> Changes | None:
    w = re.sub("['’]", "", line.old[k])
    return {k: w} if w != line.old[k] else None


def _doubled(line: Line, k: int, rng: random.Random) -> Changes | None:
    return {k: f"{line.old[k]} {line.old[k]}"}


def _swapped(line: Line, k: int, rng: random.Random) -> Changes | None:
    other = line.next_word(k)
    return None if other is None or line.changed(other) or line.old[k] == line.old[other] else {k: line.old[other], other: line.old[k]}


@dataclass(frozen=True)
class Noise:
    """What the noise does: weights, strengths, groups, the share of texts left as they are, and the least words of a text and of a line."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    profiles: dict[str, Profile] = field(default_factory=lambda: dict(PROFILES))
    groups: list[list[str]] = field(default_factory=grammar_groups)
    untouched: float = 0.05
    min_words: int = 8
    min_line_words: int = 4

    def __post_init__(self) -> None:
        if unknown := set(self.weights) - set(WEIGHTS):
            raise ValueError(f"no such operators: {sorted(unknown)}")
        if not self.profiles or "identity" in self.profiles or min(self.weights.values(), default=0) < 0 or not any(self.weights.values()):
            raise ValueError("noise needs a strength, none of them named identity, and an operator with a weight")

    def operators(self) -> dict[str, WordOperator]:
        table: dict[str, WordOperator] = {
            "confusable": partial(_one_of, alternatives(self.groups)), "drop_function_word": _without, "typo": partial(_slip, keyboard()), "case": _lost_capital,
            "preposition": partial(_one_of, alternatives(PREPOSITIONS)), "drop_apostrophe": _lost_apostrophe, "double_word": _doubled, "swap_adjacent": _swapped,
        }
        return {name: table[name] for name, w in self.weights.items() if w > 0}


_STOPS, _MARKS = ".!?", ",;:\"'“”‘’"


def _noisy_line(line: Line, rng: random.Random, rate: float, run_on: float, noise: Noise, operators: dict[str, WordOperator]) -> None:
    last = len(line.old) - 1
    for k, (kind, t) in enumerate(zip(line.kind, line.old)):
        if line.changed(k):
            continue
        if kind == "word" and rng.random() < rate:
            # exponential waiting times: the order is a weighted draw without replacement
            for name in sorted(operators, key=lambda x: rng.expovariate(noise.weights[x])):
                if changes := operators[name](line, k, rng):
                    line.apply(changes)
                    break
        elif kind == "punct" and t in _STOPS:
            word = line.next_word(k)
            if word is not None and line.old[word][0].isupper():
                if rng.random() < run_on:
                    # two sentences run together: with a comma, with nothing, or with the stop but no capital
                    line.apply({k: rng.choice([",", "", t]), word: line.old[word][0].lower() + line.old[word][1:]})
            elif k == last and rng.random() < rate / 2:
                line.apply({k: ""})
        elif kind == "punct" and t in _MARKS and rng.random() < rate:
            line.apply({k: ""})
        elif kind == "space" and k and line.kind[k - 1] == "punct" and line.new[k - 1] in (*_STOPS, *_MARKS) and not line.changed(k - 1) and rng.random() < rate / 2:
            line.apply({k: ""})


def _habits(line: Line, lowercase: bool, no_marks: bool) -> None:
    for k, kind in enumerate(line.kind):
        if kind == "word" and lowercase:
            line.new[k] = line.new[k].lower()
        if kind == "punct" and no_marks and line.old[k] in _STOPS + _MARKS:
            line.new[k] = ""
            if k + 1 < len(line.kind) and line.kind[k + 1] == "space":  # a blank that was lost after the mark comes back
                line.new[k + 1] = line.old[k + 1]


def corrupt_text(text: str, rng: random.Random, noise: Noise = Noise()) -> tuple[str | None, int, str]:
    """(corrupted, edits, profile); None for texts with too few words of prose; a text that stays as it is has profile identity."""
    lines = text.split("\n")
    prose = {n: Line(x) for n, x in enumerate(lines) if is_prose(x, noise.min_line_words)}
    if sum(x.kind.count("word") for x in prose.values()) < noise.min_words:
        return None, 0, "not_prose"
    if rng.random() < noise.untouched:
        return text, 0, "identity"
    name = rng.choices(list(noise.profiles), [p.weight for p in noise.profiles.values()])[0]
    p = noise.profiles[name]
    rate, lowercase, no_marks = rng.uniform(*p.rate), rng.random() < p.lowercase, rng.random() < p.no_marks
    operators = noise.operators()
    for n, line in prose.items():
        _noisy_line(line, rng, rate, p.run_on, noise, operators)
        _habits(line, lowercase, no_marks)
        lines[n] = "".join(line.new)
    out = "\n".join(lines)
    return (text, 0, "identity") if out == text else (out, sum(x.changed(k) for x in prose.values() for k in range(len(x.old))), name)


def corrupted_pairs(df: DataFrame, pos: str, text: str, seed: int = 17, noise: Noise = Noise()) -> DataFrame:
    """(pos, source, target, edits, profile): a corrupted text and the text; source null where it is no prose.

    Seeded by position, so any partitioning gives the same; null texts are no prose.
    """
    schema = df.select(pos).schema.add("source", "string").add("target", "string").add("edits", "integer").add("profile", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [corrupt_text(t, seeded(seed, int(p)), noise) if isinstance(t, str) and p == p else (None, 0, "not_prose") for p, t in zip(pdf[pos], pdf[text])]
            yield pd.DataFrame({pos: pdf[pos], "source": [r[0] for r in rows], "target": pdf[text], "edits": [r[1] for r in rows], "profile": [r[2] for r in rows]})

    return df.select(pos, text).mapInPandas(run, schema)


def framed_pairs(pairs: DataFrame, pos: str, encode: Callable[[Column], Column], min_source: int = 4, max_source: int = 512, max_target: int = 512) -> DataFrame:
    """(pos, example, skipped): style, open, corrupted text, close, end -> text, end; or why a pair is left out.

    ``pairs`` has source (null: no prose) and target; ``encode`` turns text into an array of token ids. The reasons are too_short (of
    the target), too_long (of either with its frame), not_prose, control_token, in this order.
    """
    coded = pairs.select(pos, encode(F.coalesce("target", F.lit(""))).alias("t"), encode(F.col("source")).alias("s"))
    reason = (
        F.when(F.size("t") < min_source, "too_short").when(F.size("t") + 1 > max_target, "too_long")
        .when(F.col("s").isNull(), "not_prose").when(F.size("s") + 4 > max_source, "too_long")
    )
    example = X.frame(F.col("s"), F.col("t"))
    out = coded.select(pos, reason.alias("_why"), F.when(reason.isNull(), example).alias("example"))
    return out.select(pos, "example", F.coalesce("_why", F.when(F.col("example").isNull(), "control_token")).alias("skipped"))


def task_report(pairs: DataFrame) -> DataFrame:
    """Per profile: pairs, their share of all, mean length of the source and edits per hundred words."""
    from pyspark.sql import Window

    n = F.size(F.split(F.coalesce("source", F.lit("")), r"\s+"))
    g = pairs.groupBy("profile").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(n), 6).alias("mean_words"), F.round(100 * F.sum("edits") / F.sum(n), 6).alias("edits_per_100"))
    return g.withColumn("share", F.round(F.col("pairs") / F.sum("pairs").over(Window.partitionBy()), 6))

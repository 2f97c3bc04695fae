"""Per-document text statistics and a classifier of structural junk (problem 2).

Weak labels come from two plain observations (the share of function words, and how lines are
built); chunks on which both agree are the training material, together with mixtures of
their lines whose share of junk is known by construction. Gradient-boosted trees are trained
on the statistics of these chunks. Hand-checked chunks calibrate the probabilities: some written for this
purpose, and half of those that were sampled from a collection and labelled by reading; the other half is never
fitted and measures the calibration (``holdout_report``).
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.handchecked import CHUNKS, SAMPLED
from loomtext.llm.lexicon import ALL_FUNCTION_WORDS
from loomtext.plans.lineage import broadcast_if_small, hash_sample

#: Chunks brought to the driver, chosen by hash, as training material.
TRAIN_CHUNKS = 6000
#: Mixtures made of their lines.
MIXTURES = 3000
#: Sources that a registry may have to be broadcast.
MAX_SOURCES = 100_000

# letters that are not part of a longer code or number
WORD = re.compile(r"(?<![\w+/])[^\W\d_]+(?![\w+/=])")
# a mark, a number or a letter in front of an entry, also when its encoding is damaged
BULLET = re.compile(r"^\s*(?:[^\w\s]{1,3}|â€.|Â.|[(#]?\d{1,3}[.):]?|\(?[a-z][.)])\s+(?=\S)")
FOREIGN = re.compile(r"[^\u0000-ɏ]|[ÃÂâ]")
STAMP = re.compile(r"\d{4}-\d\d-\d\d|\d\d:\d\d")
KEY_VALUE = re.compile(r"\w=\S|^[^.!?]{1,40}:\s*\S{1,24}$")
CELLS = re.compile(r"\t|;|\|| {2,}|»|,(?=\S)")
END = re.compile(r"[.!?…:;,][\"'”»’)\]]*$")
STOP = re.compile(r"[.!?…][\"'”»’“)\]]*$")
#: A line of up to so many words without a full stop is no sentence; one with a mark or number in front, of up to so many.
STUB, ENTRY = 6, 9
VOWELS = frozenset("aeiouyàáâäãåæèéêëìíîïòóôöõøùúûüýÿœ")

#: Single letters are too often parts of codes and garbled text.
FUNCTION = frozenset(w for w in ALL_FUNCTION_WORDS if len(w) > 1)

STATISTICS = ["word_count", "mean_word_length", "symbol_ratio", "end_punct_share", "common_word_share"]
FEATURES = [
    *STATISTICS, "sentence_chars", "rich_chars", "poor_chars", "cell_chars", "bullet_chars", "stub_chars", "entry_chars", "stamp_chars", "pair_chars", "short_chars", "long_token_chars",
    "digit_ratio", "upper_ratio", "foreign_ratio", "no_vowel_share", "top_word_share", "distinct_share", "log_lines", "line_length",
]


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES; all 0 for null and blank texts. Shares of characters count non-blank ones."""
    if not text or not text.strip():
        return [0.0] * len(FEATURES)
    chars = ended = lines = 0
    by = dict.fromkeys(FEATURES[5:16], 0)
    every: list[str] = []
    for line in text.splitlines():
        tokens = line.split()
        if not tokens:
            continue
        lines += 1
        n = sum(map(len, tokens))
        chars += n
        line = line.strip()
        words = WORD.findall(line.lower())
        every += words
        common = sum([w in FUNCTION for w in words])
        stop = STOP.search(line) is not None
        ended += stop
        bullet = BULLET.match(line) is not None
        stub = not stop and len(words) <= (ENTRY if bullet else STUB)
        rich = len(words) >= 3 and common >= 0.15 * len(words)
        if rich and not (stub and (bullet or not END.search(line))):
            by["sentence_chars"] += n
        if stub:
            by["stub_chars"] += n
        if stub and bullet:
            by["entry_chars"] += n
        if len(words) >= 4 and common >= 0.25 * len(words):
            by["rich_chars"] += n
        if common < 0.1 * len(words) or not words:
            by["poor_chars"] += n
        if len(CELLS.findall(line)) >= 2:
            by["cell_chars"] += n
        if bullet:
            by["bullet_chars"] += n
        if STAMP.search(line):
            by["stamp_chars"] += n
        if KEY_VALUE.search(line):
            by["pair_chars"] += n
        if len(tokens) <= 2:
            by["short_chars"] += n
        if n > 25:
            by["long_token_chars"] += sum(len(t) for t in tokens if len(t) > 25)
    words = every
    n_words = max(1, len(words))
    letters = sum(map(len, words))
    digits = sum(map(str.isdigit, text))
    count = Counter(words)
    out = [
        float(len(words)), letters / n_words, 1 - (letters + digits) / max(1, chars), ended / max(1, lines), sum([n for w, n in count.items() if w in FUNCTION]) / n_words,
        *(v / max(1, chars) for v in by.values()),
        digits / max(1, chars), sum(map(str.isupper, text)) / max(1, chars), len(FOREIGN.findall(text)) / max(1, chars),
        sum(n for w, n in count.items() if len(w) > 2 and VOWELS.isdisjoint(w)) / n_words, max((n for w, n in count.items() if w not in ALL_FUNCTION_WORDS), default=0) / n_words, len(count) / n_words,
        math.log1p(lines), chars / max(1, lines),
    ]
    return out


class BoostedTrees:
    """Gradient-boosted regression trees for the logistic loss, on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 20):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.slope, self.offset = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = math.log(p / (1 - p)), []
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), int)
            splits = []
            for level in range(self.depth):
                for k in range(2**level):
                    splits.append(self._split(binned, cuts, g, h, node == k))
                feature = np.array([s[0] for s in splits[-(2**level) :]])[node]
                at = np.array([s[1] for s in splits[-(2**level) :]])[node]
                node = node * 2 + (x[np.arange(len(y)), feature] > at)
            size = 2**self.depth
            leaf = self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + 1.0)
            self.trees.append((np.array([s[0] for s in splits]), np.array([s[1] for s in splits]), leaf))
            score += leaf[node]
        return self

    def _split(self, binned: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray, mask: np.ndarray) -> tuple[int, float]:
        best = (1e-9, 0, math.inf)
        if mask.sum() < 2 * self.least:
            return best[1:]
        b, gm, hm = binned[mask], g[mask], h[mask]
        whole = gm.sum() ** 2 / (hm.sum() + 1)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            n = len(c) + 1
            gl, hl, cl = (np.cumsum(np.bincount(b[:, f], w, n))[:-1] for w in (gm, hm, np.ones(len(gm))))
            gain = gl**2 / (hl + 1) + (gm.sum() - gl) ** 2 / (hm.sum() - hl + 1) - whole
            gain[(cl < self.least) | (len(gm) - cl < self.least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(c[k]))
        return best[1:]

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, at, leaf in self.trees:
            node, first = np.zeros(len(x), int), 0
            for level in range(self.depth):
                k = first + node
                node = node * 2 + (x[rows, feature[k]] > at[k])
                first += 2**level
            out += leaf[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling, with the targets drawn in as Platt proposes and a slight pull to the identity."""
        s = self.score(x)
        t = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            a -= 0.05 * (((p - t) * s).mean() + 0.05 * (a - 1))
            b -= 0.05 * ((p - t).mean() + 0.05 * b)
        self.slope, self.offset = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.score(x) + self.offset, -30, 30)))


def weak_label(text: str) -> int | None:
    """1 junk, 0 prose, None where the two observations do not agree."""
    s = dict(zip(FEATURES, statistics(text)))
    if s["sentence_chars"] >= 0.9 and s["common_word_share"] >= 0.27 and s["top_word_share"] < 0.15:
        return 0
    if s["sentence_chars"] <= 0.05 and (s["poor_chars"] >= 0.85 and s["common_word_share"] <= 0.12 or s["entry_chars"] >= 0.8 or s["foreign_ratio"] >= 0.4):
        return 1
    return None


def training_set(texts: list[str], mixtures: int = MIXTURES) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the weakly labelled texts and of mixtures of their lines."""
    junk = [t for t in texts if weak_label(t) == 1]
    prose = [t for t in texts if weak_label(t) == 0]
    rng = random.Random(11)
    rows = [(t, 1) for t in junk] + [(t, 0) for t in rng.sample(prose, min(len(prose), max(400, 3 * len(junk))))]
    size = lambda t: len(re.sub(r"\s+", "", t))
    for _ in range(mixtures if junk and prose else 0):
        a, b = rng.choice(prose).splitlines(), rng.choice(junk).splitlines()
        if rng.random() < 0.5:
            a = re.split(r"(?<=[.!?])\s+", " ".join(a))
        a, b = [x for x in a if x.strip()], [x for x in b if x.strip()]
        a, b = a[: rng.randint(1, max(1, len(a)))], b[: rng.randint(1, max(1, len(b)))]
        share = sum(map(size, b)) / max(1, sum(map(size, a)) + sum(map(size, b)))
        order = [("\n".join(a)), ("\n".join(b))]
        if rng.random() < 0.5:
            order.reverse()
        rows.append(("\n".join(order), int(share > 0.5)))
    return np.array([statistics(t) for t, _ in rows]), np.array([y for _, y in rows], float)


def train_classifier(chunks: DataFrame, id_col: str = "chunk_id", train_chunks: int = TRAIN_CHUNKS) -> BoostedTrees | None:
    """Trees calibrated on the hand-checked chunks; None when the sample holds only one class."""
    rows = sorted(hash_sample(chunks.select(id_col, "text"), id_col, train_chunks).filter("text is not null").collect(), key=lambda r: str(r[0]))
    texts = list({r[0]: r.text for r in rows}.values())
    x, y = training_set([t for t in texts if t.strip()])
    if len(y) == 0 or y.min() == y.max():
        return None
    checked = CHUNKS + SAMPLED[::2]
    return BoostedTrees().fit(x, y).calibrate(np.array([statistics(t) for t, _ in checked]), np.array([label for _, label in checked], float))


def holdout_report(model: BoostedTrees, bands: int = 5) -> tuple[float, list[tuple[int, float, float]]]:
    """The Brier score on the sampled chunks that were held out, and per band of probability: chunks, mean probability, share of junk."""
    held = SAMPLED[1::2]
    p, y = model.probability(np.array([statistics(t) for t, _ in held])), np.array([label for _, label in held], float)
    band = np.minimum((p * bands).astype(int), bands - 1)
    return float(np.mean((p - y) ** 2)), [(int((band == k).sum()), float(p[band == k].mean()), float(y[band == k].mean())) for k in range(bands) if (band == k).any()]


def text_quality(chunks: DataFrame, id_col: str = "chunk_id", model: BoostedTrees | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The five statistics of every chunk, the calibrated probability of junk, and is_junk.

    Null and blank texts have zeros, a null probability and is_junk false. Without a model and
    without both classes in the sample, prose is assumed (probability null). ``keep`` names
    columns to carry along.
    """
    model = train_classifier(chunks, id_col) if model is None else model
    schema = chunks.select(id_col, *keep).schema
    for name in STATISTICS:
        schema = schema.add(name, "long" if name == "word_count" else "double")
    schema = schema.add("junk_probability", "double").add("is_junk", "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([statistics(t) for t in pdf.text], float).reshape(len(pdf), len(FEATURES))
            blank = x.sum(axis=1) == 0
            p = model.probability(x) if model is not None and len(x) else np.full(len(x), np.nan)
            out = pdf[[id_col, *keep]].copy()
            for k, name in enumerate(STATISTICS):
                out[name] = x[:, k].astype("int64") if name == "word_count" else x[:, k]
            out["junk_probability"] = pd.Series(p, dtype="float64").where(~pd.Series(blank, dtype=bool) & ~np.isnan(p), None).values
            out["is_junk"] = (p > 0.5) & ~blank
            yield out

    return chunks.select(id_col, "text", *(k for k in keep)).mapInPandas(run, schema)


def quality_switched(chunks: DataFrame, spec: DataFrame) -> DataFrame:
    """Chunks whose source, in whatever spelling, has ``pipeline.quality`` switched on."""
    key = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
    on = spec.filter("pipeline.quality").select(key(F.col("source_id")).alias("_key")).distinct()
    return chunks.join(broadcast_if_small(on, MAX_SOURCES), key(F.col("source_id")) == F.col("_key"), "left_semi")

"""Keyword-stuffed pages and lists of links or product tags (problem 8).

A page becomes sentences (pieces), and each piece a sequence of function words and word classes.
An interpolated trigram model of such sequences is trained on all prose of the same collection and
gives every piece its surprise, the logarithm of its perplexity. Classes that prose hardly knows
(links, prices, hyphenated tags, words repeated over and over, and the second word of a pair of words
that returns over and over) make link lists, tag lists and stuffed pages surprising in
proportion to their share. A page is flagged when more than half of its words lie in pieces
whose surprise is outside the calibrated range. One check stands beside the model: code and command lines,
which are as unusual as spam, are left out by their type.

The range is calibrated on the value that decides about a page, counted over all pages: it ends in the gap between the
bulk of pages with hardly a marked class and the pages beyond. Texts are read once, into arrays of numbered classes, which
are counted by a grouped sum and scored with arrays; only the counts of trigrams and of rounded values come to the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.lexicon import ALL_FUNCTION_WORDS
from loomtext.plans.lineage import materialize

#: A content word is heavy from this share of the content words on, a pair of neighbouring words from this share of all; four times at least.
HEAVY_WORD, HEAVY_PAIR, LEAST = 0.06, 0.05, 4
#: Tokens that a worker remembers before it starts anew.
MEMORY = 300_000

LINK = re.compile(r"(?i)https?:|://|\bwww\.|\bhref=|mailto:")
PRODUCT = re.compile(r"(?i)^\W*(?:sku|ref|art|item|isbn|ean|asin|n[ro°º]|mpn)\b")
PRICE = re.compile(r"^[$€£]|[$€£]$|^\W*\d+[.,]\d\d\W*$")
TAG = re.compile(r"^[^\w#]*(?:#\w+|[^\W\d_]+(?:[-_][^\W\d_]+)+)\W*$")
CODE_TOKEN = re.compile(r"[{}()=]|\w/\w|^--?\w")
EDGE = ".,;:!?\"'()[]{}«»“”…-|"


class Token(NamedTuple):
    """What the pieces and the symbols need to know of a blank-separated token, wherever it stands."""

    core: str
    function: bool
    symbol: str
    end: str
    link: bool
    product: bool
    digit: bool
    code: bool
    stops: bool


_TOKENS: dict[str, Token] = {}


def look(t: str) -> Token:
    """The token's class, from a memory that every worker keeps."""
    got = _TOKENS.get(t)
    if got is not None:
        return got
    core = t.strip(EDGE).lower()
    function, link = core in ALL_FUNCTION_WORDS, LINK.search(t) is not None
    digit = any(c.isdigit() for c in core)
    if not core:
        symbol = "|"
    elif function:
        symbol = core
    elif link:
        symbol = "<link>"
    elif PRICE.search(t):
        symbol = "<price>"
    elif digit:
        symbol = "<num>"
    elif TAG.match(t):
        symbol = "<tag>"
    elif not core.isalpha():
        symbol = "<mix>"
    else:
        symbol = ""  # a plain word: its class depends on the text
    got = Token(core, function, symbol, t[-1] if t[-1] in ".!?,;:" else "", link, PRODUCT.match(t) is not None, digit, not link and CODE_TOKEN.search(t) is not None, t[-1] in ".!?")
    if len(_TOKENS) >= MEMORY:
        _TOKENS.clear()
    _TOKENS[t] = got
    return got


class Piece(NamedTuple):
    tokens: list[tuple[str, Token]]
    is_code: bool


def _piece(tokens: list[tuple[str, Token]]) -> tuple[bool, bool]:
    """(code, poor): whether a sentence is code or a command, and whether it has hardly a function word and nothing marked."""
    link = any(k.link for _, k in tokens)
    product = any(k.product and (k.digit or i + 1 < len(tokens) and tokens[i + 1][1].digit) for i, (_, k) in enumerate(tokens))
    first, last = tokens[0][0], tokens[-1][0]
    code = not link and not product and (any(k.code for _, k in tokens) or first[0] in "@$>`" or first == "#" or last[-1] == ";")
    words = [k for _, k in tokens if k.core]
    return code, not (link or product or code) and sum(k.function for k in words) <= 0.1 * len(words)


def pieces(text: str) -> list[Piece]:
    """The sentences of every line; neighbours that are poor are one piece, tokens without a word belong to the piece before."""
    out: list[Piece] = []
    joins = False
    for line in text.splitlines():
        sentence: list[tuple[str, Token]] = []
        tokens = line.split()
        for n, t in enumerate(tokens):
            k = look(t)
            sentence.append((t, k))
            if not k.stops and n + 1 < len(tokens):
                continue
            if not any(x.core for _, x in sentence):
                if out:
                    out[-1].tokens.extend(sentence)
                    sentence = []
                continue
            code, poor = _piece(sentence)
            if poor and joins:
                out[-1].tokens.extend(sentence)
            else:
                out.append(Piece(sentence, code))
            joins, sentence = poor, []
    return out


def heavy(parts: list[Piece]) -> tuple[set[str], set[tuple[str, str]]]:
    """Content words and pairs of neighbouring words (not both function words) that make up an unusual share of a text."""
    words = [k for p in parts for _, k in p.tokens if k.core]
    content = Counter(k.core for k in words if not k.function and not k.core.isdigit())
    least = max(LEAST, HEAVY_WORD * content.total())
    pairs = Counter((a.core, b.core) for a, b in zip(words, words[1:]) if not (a.function and b.function))
    often = max(LEAST, HEAVY_PAIR * len(words))
    return {w for w, n in content.items() if n >= least}, {p for p, n in pairs.items() if n >= often}


def symbols(piece: Piece, again: tuple[set[str], set[tuple[str, str]]]) -> list[str]:
    """Function words as they are, other words by class; the fourth content word in a row is a class of its own."""
    words, pairs = again
    out, run, before = ["^"], 0, ""
    for t, k in piece.tokens:
        run = 0 if k.function else run + bool(k.core)
        if pairs and (before, k.core) in pairs:
            out.append("<again>")
        elif k.symbol:
            out.append(k.symbol)
        elif k.core in words:
            out.append("<rep>")
        else:
            out.append("<run>" if run > 3 else "<Cap>" if t[0].isupper() else "<low>")
        if k.end:
            out.append(k.end)
        before = k.core or before
    out.append("$")
    return out


def is_prose(parts: list[Piece], again: tuple[set[str], set[tuple[str, str]]]) -> bool:
    """Weak choice of training prose: many function words, no links, tags or code, nothing heavily repeated."""
    words, pairs = again
    if pairs or any(p.is_code for p in parts):
        return False
    tokens = [k for p in parts for _, k in p.tokens if k.core]
    if len(tokens) < 12 or any(k.symbol in ("<link>", "<price>") for k in tokens):
        return False
    return sum(k.function for k in tokens) >= 0.3 * len(tokens) and sum(k.core in words for k in tokens) <= 0.1 * len(tokens)


#: Classes that link lists, tag lists and stuffed pages are made of.
MARKED = frozenset(["<link>", "<price>", "<tag>", "<rep>", "<again>"])
#: All that ``symbols`` returns, by number; the first two are the ends of a piece.
ALPHABET = ["^", "$", *".!?,;:|", *sorted(MARKED), "<num>", "<mix>", "<run>", "<Cap>", "<low>", *sorted(ALL_FUNCTION_WORDS)]
NUMBER = {x: n for n, x in enumerate(ALPHABET)}
SIZE = len(ALPHABET)
_IS_CLASS = np.array([x[0] not in ".!?,;:|" for x in ALPHABET]) & (np.arange(SIZE) > 1)
_IS_MARKED = np.array([x in MARKED for x in ALPHABET])


class Page(NamedTuple):
    """A text as numbered classes, piece after piece; tokens of every piece and whether it is code."""

    symbols: np.ndarray
    words: np.ndarray
    code: np.ndarray
    prose: bool
    label: int


def weak_label(symbols: np.ndarray, code: np.ndarray) -> int:
    """1 for pages that are spam at first sight (most words are marked), 0 for pages with hardly a marked word, -1 between."""
    plain = symbols[~np.repeat(code, np.diff(np.append(np.flatnonzero(symbols == 0), len(symbols))))]
    classes, marked = int(_IS_CLASS[plain].sum()), int(_IS_MARKED[plain].sum())
    return -1 if classes < 8 else 1 if marked > 0.6 * classes else 0 if marked <= 0.1 * classes else -1


def read_page(text: str | None) -> Page:
    parts = pieces(text) if isinstance(text, str) else []
    again = heavy(parts)
    numbers = np.array([NUMBER[x] for p in parts for x in symbols(p, again)], np.int16)
    code = np.array([p.is_code for p in parts], bool)
    return Page(numbers, np.array([len(p.tokens) for p in parts], np.int32), code, is_prose(parts, again), weak_label(numbers, code))


def prose_words(text: str | None) -> set[str]:
    """The plain words of a text that is prose."""
    parts = pieces(text) if isinstance(text, str) else []
    return {k.core for p in parts for _, k in p.tokens if not k.symbol} if is_prose(parts, heavy(parts)) else set()


def built_pages(words: list[str]) -> list[str]:
    """Stuffed pages and link lists made of words of prose, for collections in which no page is spam at first sight; all words are of one class."""
    stuffed = [", ".join([f"{a} {b}"] * 4 + [f"{b} {a}"] * 4) for a, b in zip(words[::2], words[1::2])]
    return stuffed + [" - ".join([f"[{a} {b}](http://{a}.example/{b})"] * 4) for a, b in zip(words[::2], words[1::2])]


#: Words of prose, the first by alphabet, that built pages are made of.
BUILT_WORDS = 2000
#: Steps by which pages are counted, of a unit of surprise; a gap begins where at most this share of the ordinary pages' number follows in so many steps.
STEPS, RARE, GAP = 1000, 0.001, 1000


def trigrams(symbols: np.ndarray) -> np.ndarray:
    """The number of the trigram that ends after each symbol but the last of a piece; a piece begins with two marks."""
    before = np.append(np.zeros(1, symbols.dtype), symbols)[: len(symbols)]
    before[symbols == 0] = 0
    inside = np.flatnonzero(symbols != 1)
    return (before[inside].astype(np.int64) * SIZE + symbols[inside]) * SIZE + symbols[inside + 1]


class SequenceModel:
    """Interpolated trigrams over the symbols of prose, and the range of surprise that ordinary pages keep to."""

    def __init__(self, texts: list[str] | None = None):
        self.low, self.high = 0.0, math.inf
        if texts is None:
            return
        pages = [read_page(t) for t in texts]
        self.count(*np.unique(np.concatenate([np.zeros(0, np.int64), *(trigrams(p.symbols) for p in pages if p.prose)]), return_counts=True))
        seen = Counter((p.label, int(np.floor(self.page_surprise(p) * STEPS))) for p in pages)
        words = [] if any(label == 1 and at > 0 for label, at in seen) else sorted(set().union(*map(prose_words, texts)))[:BUILT_WORDS]
        self.calibrate(np.array([(label, at, n) for (label, at), n in seen.items()], np.int64).reshape(-1, 3), words)

    def count(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Takes the numbers of trigrams (sorted) and how often prose has them."""
        a, b, c = keys // SIZE**2, keys // SIZE % SIZE, keys % SIZE
        single = (np.bincount(c, n, SIZE) + 0.5) / (n.sum() + 500)
        two, one, pair = np.bincount(b * SIZE + c, n, SIZE**2).reshape(SIZE, SIZE), np.bincount(b, n, SIZE), np.bincount(a * SIZE + b, n, SIZE**2)
        after = np.where(one[:, None] > 0, two / np.maximum(one, 1)[:, None], single)
        self.base = 0.1 * single + 0.3 * after
        self.keys, self.more = keys, 0.6 * n / np.maximum(pair[a * SIZE + b], 1)

    def calibrate(self, seen: np.ndarray, words: list[str]) -> None:
        """Sets the range from rows of label, value in steps and number of pages; without spam at first sight, from pages built of ``words``.

        Pages whose value is 0 can't be flagged and say nothing. The range ends in the gap above the ordinary pages. The gap
        begins where hardly a page of any label follows, so that single odd pages don't move it, and reaches to all pages
        beyond that aren't ordinary, since the spam at first sight was chosen for being extreme.
        """
        label, at, n = seen[seen[:, 1] > 0].T
        self.low, self.high = 0.0, math.inf
        if not (label == 0).any():
            return
        least, most, top = quantiles(at[label == 0], n[label == 0], 0.001, 0.99, 0.999)
        #: Half of the least value of an ordinary page: sequences so predictable that no writer makes them.
        self.low = least / STEPS / 2
        order = np.argsort(at)
        places, upto = at[order], np.append(0, np.cumsum(n[order]))
        before = lambda x: upto[np.searchsorted(places, x)]
        few = RARE * n[label == 0].sum()
        starts = np.append(most, np.unique(at[at >= most])) + 1
        begin = starts[np.argmax(before(starts + GAP) - before(starts) <= few)]
        spam, odd = (label == 1) & (at >= begin), (label != 0) & (at >= begin)
        ends = []
        if spam.any():
            ends += quantiles(at[spam], n[spam], 0.01)
            # as many pages as may lie in the gap by chance are no end of it
            share = max(0.02, few / n[odd].sum())
            ends += quantiles(at[odd], n[odd], share) if share < 1 else []
        elif not (label == 1).any() and words:
            made = np.array([int(self.page_surprise(read_page(t)) * STEPS) for t in built_pages(words)], np.int64)
            ends += quantiles(made, np.ones_like(made), 0.01) if len(made) else []
        end = min(ends, default=0)
        if end <= begin:
            self.high = 1.5 * top / STEPS
            return
        #: A third of the way: spam thins out slowly towards ordinary pages, which end at once.
        self.high = float(begin + (end - begin) / 3) / STEPS

    def surprises(self, symbols: np.ndarray) -> np.ndarray:
        """Per piece the mean negative log probability of a symbol: the logarithm of the perplexity."""
        if not len(symbols):
            return np.zeros(0)
        t = trigrams(symbols)
        p = self.base[t // SIZE % SIZE, t % SIZE]
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, t), len(self.keys) - 1)
            p = p + np.where(self.keys[place] == t, self.more[place], 0.0)
        n = np.diff(np.append(np.flatnonzero(symbols == 0), len(symbols))) - 1
        return np.add.reduceat(-np.log(p), np.cumsum(n) - n) / n

    def page_surprises(self, symbols: np.ndarray, words: np.ndarray, code: np.ndarray, owner: np.ndarray, pages: int) -> np.ndarray:
        """Per page the least surprise among the pieces that make up more than half of its words, the most surprising first; ``owner`` is the page of every piece.

        A page is flagged if this lies beyond the range. Code is never surprising: 0 where the rest is not more than half.
        """
        whole = np.bincount(owner, words, pages)
        x = self.surprises(symbols)[~code]
        n, owner = words[~code], owner[~code]
        order = np.lexsort((-n, -x, owner))
        x, n, owner = x[order], n[order], owner[order]
        own = np.bincount(owner, n, pages)
        seen = np.cumsum(n) - (np.cumsum(own) - own)[owner]
        reached = np.flatnonzero(seen > whole[owner] / 2)
        out = np.zeros(pages)
        page, first = np.unique(owner[reached], return_index=True)
        out[page] = x[reached[first]]
        return out

    def page_surprise(self, page: Page) -> float:
        return float(self.page_surprises(page.symbols, page.words, page.code, np.zeros(len(page.words), int), 1)[0])

    def page_shares(self, symbols: np.ndarray, words: np.ndarray, code: np.ndarray, owner: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
        """Per page the shares of the words in abnormal pieces that are not code, and in all abnormal pieces."""
        x = self.surprises(symbols)
        odd = words * ((x > self.high) | (x < self.low))
        total = np.maximum(np.bincount(owner, words, pages), 1)
        return np.bincount(owner, odd * ~code, pages) / total, np.bincount(owner, odd, pages) / total

    def shares(self, text: str) -> tuple[float, float]:
        page = read_page(text)
        bad, odd = self.page_shares(page.symbols, page.words, page.code, np.zeros(len(page.words), int), 1)
        return float(bad[0]), float(odd[0])


def rank(n: int, q: float) -> int:
    """The place of quantile ``q`` among ``n`` sorted values."""
    return min(n - 1, int(q * n))


def quantiles(values: np.ndarray, n: np.ndarray, *wanted: float) -> list[int]:
    """Quantiles of values that occur ``n`` times each."""
    order = np.argsort(values)
    upto = np.cumsum(n[order])
    return [int(values[order][np.searchsorted(upto, rank(int(upto[-1]), q), side="right")]) for q in wanted]


PAGE = "doc_id long, symbols binary, words binary, code binary, prose boolean, label int"


def read_pages(docs: DataFrame) -> DataFrame:
    """Every document as arrays (``Page``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [read_page(t) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "symbols": [r.symbols.tobytes() for r in rows], "words": [r.words.tobytes() for r in rows], "code": [r.code.tobytes() for r in rows], "prose": [r.prose for r in rows], "label": [r.label for r in rows]})

    return docs.select("doc_id", "text").mapInPandas(run, PAGE)


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The pages of a batch one after the other, as ``page_surprises`` takes them."""
    symbols, words, code = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (("symbols", np.int16), ("words", np.int32), ("code", bool)))
    return symbols, words, code, np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["code"]]), len(pdf)


def _once(pages: DataFrame) -> DataFrame:
    """Pages whose id was delivered several times count once (the greatest of them)."""
    several = pages.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    if several.isEmpty():
        return pages
    marked = pages.join(several, "doc_id", "left")
    rest = [c for c in pages.columns if c != "doc_id"]
    one = marked.filter("_times is not null").groupBy("doc_id").agg(F.max(F.struct(*rest)).alias("_page")).select("doc_id", "_page.*")
    return marked.filter("_times is null").drop("_times").unionByName(one.select(*pages.columns))


def train_pages(pages: DataFrame, docs: DataFrame) -> SequenceModel:
    """The model of all prose among ``pages`` (of ``docs``), its range from all of them."""
    pages = _once(pages)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key, n = np.unique(trigrams(_arrays(pdf)[0]), return_counts=True)
            yield pd.DataFrame({"key": key, "n": n})

    model = SequenceModel()
    got = pages.filter("prose").select("doc_id", "symbols", "words", "code").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = got["key"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(keys)
    model.count(keys[order], n[order])

    def value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.floor(model.page_surprises(*_arrays(pdf)) * STEPS).astype(np.int64)
            yield pdf[["label"]].assign(at=at).value_counts().rename("n").reset_index()

    found = pages.mapInPandas(value, "label int, at long, n long").groupBy("label", "at").agg(F.sum("n").alias("n")).toArrow()
    seen = np.stack([found[c].to_numpy() for c in ("label", "at", "n")], 1).astype(np.int64)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": sorted(set().union(*map(prose_words, pdf.text)))}, dtype=object)

    built = [] if ((seen[:, 0] == 1) & (seen[:, 1] > 0)).any() else sorted(r.word for r in docs.select("text").mapInPandas(words, "word string").distinct().orderBy("word").limit(BUILT_WORDS).collect())
    model.calibrate(seen, built)
    return model


def train_model(docs: DataFrame) -> SequenceModel:
    """The model of all documents."""
    return train_pages(materialize(read_pages(docs), "pages"), docs)


def spam_pages(docs: DataFrame, model: SequenceModel | None = None) -> DataFrame:
    """(doc_id, spam_share, abnormal_share, is_spam) of every document.

    ``spam_share`` counts the words in pieces of abnormal perplexity that are not code; a page is spam
    when it is over a half. Null and blank texts have shares of 0 and are never spam. Other columns are ignored.
    Texts are read once; scoring is map-only. A collection without any prose flags nothing.
    """
    pages = read_pages(docs)
    if model is None:
        pages = materialize(pages, "pages")
        model = train_pages(pages, docs)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad, odd = model.page_shares(*_arrays(pdf))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "spam_share": bad, "abnormal_share": odd, "is_spam": bad > 0.5})

    return pages.mapInPandas(score, "doc_id long, spam_share double, abnormal_share double, is_spam boolean")

"""Evaluation passages inside a corpus (problem 6).

The test items form a BM25 inverted index of their neighbouring word pairs, small enough for
every worker; every passage of every document is a query against it. (Pairs instead of single
words: the passages of one domain share most words, but few pairs, so far fewer lists are opened.) Retrieval is block-max WAND with a threshold that
loses nothing: the weights of an item are divided by the least score that any run of
``min_run`` of its words can reach, so each passage that holds such a run scores at least 1.
What is retrieved is verified word by word. (The items of the test data are single texts: where a
table holds questions and answers apart, each is an item of its own.)
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
MIN_RUN = 15
#: Passages start every STRIDE words and hold STRIDE + min_run - 1 words: each run lies whole in one.
STRIDE = 30
BLOCK = 16
#: Items of one index, which every worker holds; more of them are searched shard by shard.
SHARD_ITEMS = 50_000
K1, B = 1.2, 0.75


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def terms_of(w: list[str]) -> list[tuple[str, str]]:
    return list(zip(w, w[1:]))


class ItemIndex:
    """Postings of normalised BM25 weights in blocks with their maxima."""

    def __init__(self, items: list[tuple[int, str | None]], min_run: int = MIN_RUN):
        self.min_run = min_run
        kept = [(i, w) for i, t in sorted(items, key=lambda x: x[0]) if len(w := words(t)) >= min_run]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        df = Counter(t for _, w in kept for t in set(terms_of(w)))
        mean = sum(len(w) for _, w in kept) / max(1, len(kept))
        idf = {t: math.log(1 + (len(kept) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        lists: dict[tuple[str, str], list[tuple[int, float]]] = defaultdict(list)
        for k, (_, w) in enumerate(kept):
            norm = K1 * (1 - B + B * len(w) / mean)
            weight = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(terms_of(w)).items()}
            least = min(sum(weight[t] for t in set(terms_of(w[p : p + min_run]))) for p in range(len(w) - min_run + 1))
            for t, x in weight.items():
                lists[t].append((k, x / least))
        self.post = {}
        for t, entries in lists.items():
            at, x = [k for k, _ in entries], [v for _, v in entries]
            ends = [at[min(j + BLOCK, len(at)) - 1] for j in range(0, len(at), BLOCK)]
            tops = [max(x[j : j + BLOCK]) for j in range(0, len(at), BLOCK)]
            self.post[t] = (at, x, ends, tops, max(tops))
        self.numbers = {x: k for k, x in enumerate(sorted({x for w in self.words for x in w}))}
        tops = sorted((self.numbers[a] * len(self.numbers) + self.numbers[b], p[4]) for (a, b), p in self.post.items())
        self.pair_keys, self.pair_tops = np.array([k for k, _ in tops], np.int64), np.array([x for _, x in tops], float)
        self.runs = [{tuple(w[p : p + min_run]) for p in range(len(w) - min_run + 1)} for w in self.words]

    def retrieve(self, terms: set[tuple[str, str]]) -> list[int]:
        """Items that score at least 1 (less a rounding margin) for the set of terms: block-max WAND."""
        lists = [p for t in terms if (p := self.post.get(t))]
        theta = 1 - 1e-9
        if sum(p[4] for p in lists) < theta:
            return []
        found, end = [], len(self.ids)
        # cursor: [current item, posting list, position]
        cursors = [[p[0][0], p, 0] for p in lists]
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for n, c in enumerate(cursors):
                bound += c[1][4]
                if bound >= theta:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # bounds of the blocks that could hold the pivot
            block_bound, block_end = 0.0, end
            for c in cursors[: pivot + 1]:
                b = bisect_left(c[1][2], item)
                if b < len(c[1][2]):
                    block_bound += c[1][3][b]
                    block_end = min(block_end, c[1][2][b])
            if block_bound >= theta:
                if cursors[0][0] == item:
                    if sum(c[1][1][c[2]] for c in cursors[: pivot + 1]) >= theta:
                        found.append(item)
                    target = item + 1
                else:
                    target = item
            else:
                target = block_end + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
            alive = []
            for n, c in enumerate(cursors):
                if n <= pivot and c[0] < target:
                    c[2] = bisect_left(c[1][0], target, c[2])
                    if c[2] >= len(c[1][0]):
                        continue
                    c[0] = c[1][0][c[2]]
                alive.append(c)
            cursors = alive
        return found

    def candidates(self, docs: list[list[str]]) -> list[list[int]]:
        """Per document the starts of the passages whose lists' maxima add up to the threshold: WAND can skip all others.

        One array pass over a batch: words of the items have numbers, pairs of numbers are looked
        up in the sorted pairs of the index, and running sums give the bound of every passage. A pair counts
        only inside an unbroken row of ``min_run`` - 1 indexed pairs or more, as in every run that an item shares.
        """
        n, known = self.min_run, self.numbers
        lengths = np.array([len(w) for w in docs])
        flat = np.fromiter((known.get(x, -1) for w in docs for x in w), np.int64, int(lengths.sum()))
        key = np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1] * len(known) + flat[1:], -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        last = np.cumsum(lengths) - 1
        hit[last[(last >= 0) & (last < len(hit))]] = False  # no pair reaches into the next document
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        kept = np.zeros(len(hit) + 1, np.int64)
        long = end - begin >= n - 1
        np.add.at(kept, begin[long], 1)
        np.add.at(kept, end[long], -1)
        top = np.where(np.cumsum(kept[:-1]) > 0, self.pair_tops[at], 0.0)
        bound = np.concatenate([[0.0], np.cumsum(top)])
        out, first = [], 0
        for length in lengths.tolist():
            starts = np.arange(0, max(0, length - n + 1), STRIDE)
            ends = np.minimum(starts + STRIDE + n - 2, length - 1)
            out.append(starts[bound[first + ends] - bound[first + starts] >= 1 - 1e-6].tolist())
            first += length
        return out

    def leaks(self, w: list[str], starts: list[int]) -> list[tuple[int, int, float]]:
        """(item_id, words in common runs, their share of the item) of every item that leaks into the passages at ``starts``."""
        n = self.min_run
        hit: dict[int, set[int]] = defaultdict(set)
        for start in starts:
            passage = w[start : start + STRIDE + n - 1]
            for k in self.retrieve(set(terms_of(passage))):
                runs = self.runs[k]
                for p in range(len(passage) - n + 1):
                    if tuple(passage[p : p + n]) in runs:
                        hit[k].update(range(start + p, start + p + n))
        return [(self.ids[k], len(at), min(1.0, len(at) / len(self.words[k]))) for k, at in sorted(hit.items())]

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """The leaks of every text."""
        docs = [words(t) for t in texts]
        if not self.ids or sum(map(len, docs)) < 2:
            return [[] for _ in docs]
        return [self.leaks(w, starts) if starts else [] for w, starts in zip(docs, self.candidates(docs))]


def _index_of(items: DataFrame, min_run: int) -> ItemIndex:
    return ItemIndex([(r.item_id, r.text) for r in items.collect()], min_run)


def find_leaks(docs: DataFrame, items: DataFrame, min_run: int = MIN_RUN, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every (doc_id, item_id) that share at least ``min_run`` consecutive words.

    Also the number of the document's words in such runs and their share of the item's words.
    Null, blank and shorter texts give no rows; a doc_id that occurs twice gives each row twice
    only if its texts differ in their result. Map-only; the documents are not shuffled. More than
    ``shard_items`` items are indexed in shards by hash, one pass over the documents for each; the
    weights only order the search, so sharding changes no result.
    """
    items = items.filter("item_id is not null and text is not null").select("item_id", "text")
    shards = max(1, math.ceil(items.count() / shard_items))
    parts = [items.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k) for k in range(shards)]

    def searcher(index: ItemIndex):
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [(d, *leak) for d, found in zip(pdf.doc_id, index.search(list(pdf.text))) for leak in found]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "item_share"])

        return search

    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    found = [texts.mapInPandas(searcher(_index_of(part, min_run)), "doc_id long, item_id long, n_words int, item_share double") for part in parts]
    return reduce(DataFrame.unionByName, found)

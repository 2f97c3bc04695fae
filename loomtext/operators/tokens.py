"""Tokenizers: user-supplied encoders, reports over token counts, piece segmentation, comparisons.

No tokenizer is trained here; one is given by its file or by its pieces.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.plans.lineage import materialize

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def sentencepiece_encoder(path: str = TOKENIZER) -> Callable[[list[str]], list[list[int]]]:
    """An encoder of batches; the model is loaded once per worker."""
    return lambda texts: _processor(path).encode(texts, num_threads=1)


def encode(df: DataFrame, keys: list[str], text: str, encoder: Callable[[list[str]], list[list[int]]], out: str = "ids") -> DataFrame:
    """(keys, ids): any encoder from batches of texts to lists of ids; null texts give null."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([*df.select(*keys).schema.fields, StructField(out, ArrayType(IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            there = pdf[text].notna()
            ids = pd.Series([None] * len(pdf), dtype=object, index=pdf.index)
            ids[there] = pd.Series(encoder(pdf.loc[there, text].tolist()), index=pdf.index[there], dtype=object)
            yield pdf[keys].assign(**{out: ids})

    return df.select(*dict.fromkeys([*keys, text])).mapInPandas(run, schema)


def token_report(df: DataFrame, source: str, file: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """Lines, bytes, line_tokens and record_tokens by source and file, by source, and in all (``level`` 0, 1, 3).

    Lines are encoded one by one for line_tokens and as a whole for record_tokens: two
    different figures.
    """
    schema = "source string, file string, lines long, bytes long, line_tokens long, record_tokens long"
    encoder = sentencepiece_encoder(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            whole = encoder(pdf.iloc[:, 2].tolist())
            for s, f, t, ids in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], pdf.iloc[:, 2], whole):
                lines = [x for x in t.split("\n") if x.strip()]
                rows.append((s, f, len(lines), len(t.encode()), sum(map(len, encoder(lines))) if lines else 0, len(ids)))
            yield pd.DataFrame(rows, columns=["source", "file", "lines", "bytes", "line_tokens", "record_tokens"])

    counted = df.filter(F.col(text).isNotNull()).select(F.col(source), F.col(file).cast("string"), F.col(text)).mapInPandas(run, schema)
    sums = [F.sum(c).alias(c) for c in ("lines", "bytes", "line_tokens", "record_tokens")]
    return counted.rollup("source", "file").agg(*sums, F.grouping_id().cast("int").alias("level"))


def scan_report(df: DataFrame, source: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """Per source: records, exact round trips, tokens, words, characters, unknown and byte tokens, the longest record."""
    schema = "source string, ok int, tokens int, words int, chars int, unk int, byte_tokens int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = _processor(path)
        for pdf in batches:
            rows = []
            for s, t, ids in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], sp.encode(pdf.iloc[:, 1].tolist(), num_threads=1)):
                back = sp.decode(ids)
                rows.append((s, int(back == t), len(ids), len(t.split()), len(t), sum(map(sp.is_unknown, ids)), sum(map(sp.is_byte, ids))))
            yield pd.DataFrame(rows, columns=["source", "ok", "tokens", "words", "chars", "unk", "byte_tokens"])

    rows = df.filter(F.col(text).isNotNull()).select(source, text).mapInPandas(run, schema)
    sums = [F.sum(c).alias(c) for c in ("ok", "tokens", "words", "chars", "unk", "byte_tokens")]
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("records"), *sums, F.max("tokens").alias("max_tokens"))


def id_histogram(ids: DataFrame, name: str, vocabulary: int) -> DataFrame:
    """(id, n) of every id of the vocabulary, 0 for those that never occur."""
    spark = ids.sparkSession
    n = ids.select(F.explode(name).alias("id")).groupBy(F.col("id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(vocabulary).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


#: Byte pieces of white space, which say nothing about a text's script.
WHITE_BYTES = ["<0x09>", "<0x0A>", "<0x0B>", "<0x0C>", "<0x0D>", "<0x20>"]


def fitness(df: DataFrame, keys: list[str], text: str, code: str, path: str = TOKENIZER, qa: str | None = None, byte_share: float = 0.02, most: float = 4.0) -> DataFrame:
    """(keys, byte_fallback, fertility): a large share of byte tokens other than white space; many tokens a word over thirty words and more.

    ``code`` names a boolean column: code may have 5 % of byte tokens instead of 2 %, and no limit of tokens a word.
    Nor have the questions that the boolean column ``qa`` names.
    """
    from pyspark.sql.types import BooleanType, StructField, StructType

    schema = StructType([*df.select(*keys).schema.fields, StructField("byte_fallback", BooleanType()), StructField("fertility", BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = _processor(path)
        white = {i for i in map(sp.piece_to_id, WHITE_BYTES) if sp.is_byte(i)}
        for pdf in batches:
            out = []
            for t, is_code, free in zip(pdf[text].fillna(""), pdf[code], pdf[code] | pdf[qa] if qa else pdf[code]):
                ids = sp.encode(t)
                bytes_, words = sum(sp.is_byte(i) and i not in white for i in ids), len(t.split())
                out.append((bytes_ >= (0.05 if is_code else byte_share) * max(1, len(ids)) and bytes_ > 0, not free and words >= 30 and len(ids) >= most * words))
            yield pdf[keys].assign(byte_fallback=[a for a, _ in out], fertility=[b for _, b in out])

    return df.select(*dict.fromkeys([*keys, text, code, *([qa] if qa else [])])).mapInPandas(run, schema)


# ------------------------------------------------------------------ escaped text, gates
def escape(text: str) -> str:
    """What ``functions.text.escape_markers`` does, for encoders in Python."""
    return text.replace(T.ESC, T.ESC * 2).replace(T.MARKER, T.ESC + T.ESC_MARK)


def unescape(text: str) -> str:
    return T.ESC.join(part.replace(T.ESC + T.ESC_MARK, T.MARKER) for part in text.split(T.ESC * 2))


def decode(df: DataFrame, keys: list[str], ids: str, path: str = TOKENIZER, out: str = "text") -> DataFrame:
    """(keys, text): ids back to the text they were encoded from, escapes undone; null ids give null."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.select(*keys).schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keys].assign(**{out: pd.Series([None if x is None else unescape(_processor(path).decode([int(i) for i in x])) for x in pdf[ids]], dtype=object, index=pdf.index)})

    return df.select(*dict.fromkeys([*keys, ids])).mapInPandas(run, schema)


def escaped_encoder(path: str = TOKENIZER) -> Callable[[list[str]], list[list[int]]]:
    """The encoder for text that may hold the word marker itself."""
    return lambda texts: _processor(path).encode([escape(t) for t in texts], num_threads=1)


LINKS = re.compile(r"\[[^\]\n]*\]\([^)\s]+\)|https?://[^\s)\]>\"']+")

# Limits of the gates.
LIMITS = {"fertility_low": 1.25, "fertility_high": 1.40, "byte_share": 0.005, "chars_per_token": 3.0, "utilization": 0.90, "tokens_per_slot": 100, "rare": 10}


def scan_counts(df: DataFrame, source: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(kind, source, key, n): all that the gates need, from one pass over the texts.

    Kinds: ``sum`` (key: records, ok, tokens, words, chars, unk, byte_tokens), ``id`` and ``length`` (key: the number), ``link`` and ``bad_link``
    (key: a digest of the link). Counted inside every task and then summed: the result is bounded by sources, vocabulary, lengths and different links.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = _processor(path)
        whole = lambda t, ids: unescape(sp.decode(ids)) == t
        for pdf in batches:
            n: Counter[tuple[str, str | None, str]] = Counter()
            for s, t, ids in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], sp.encode([escape(t) for t in pdf.iloc[:, 1]], num_threads=1)):
                figures = {"records": 1, "ok": whole(t, ids), "tokens": len(ids), "words": len(t.split()), "chars": len(t), "unk": sum(map(sp.is_unknown, ids)), "byte_tokens": sum(map(sp.is_byte, ids))}
                for k, v in figures.items():
                    n["sum", s, k] += v
                for i in ids:
                    n["id", None, str(i)] += 1
                n["length", None, str(len(ids))] += 1
                for link in LINKS.findall(t):
                    kind = "link" if whole(link, sp.encode(escape(link))) else "bad_link"
                    n[kind, None, xxhash.xxh128_hexdigest(link)] += 1
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "source", "key", "n"])

    rows = df.filter(F.col(text).isNotNull()).select(source, text).mapInPandas(run, "kind string, source string, key string, n long")
    return rows.groupBy("kind", "source", "key").agg(F.sum("n").alias("n"))


def model_gates(specials: dict[str, int], builtin: dict[str, int], path: str = TOKENIZER) -> list[tuple[int, str, bool, bool, float]]:
    """Gates on the model alone: reserved names are one piece each and built-in names resolve to their ids and back; the size of the vocabulary."""
    sp = _processor(path)
    bad = sum(len(ids := sp.encode(name)) != 1 or sp.is_unknown(ids[0]) or ids[0] != want for name, want in specials.items())
    bad += sum(sp.piece_to_id(name) != want or sp.id_to_piece(want) != name for name, want in builtin.items())
    return [(3, "reserved_names", True, bad == 0, float(bad)), (7, "vocabulary", False, True, float(sp.get_piece_size()))]


def validation_gates(
    counts: DataFrame, specials: dict[str, int] | None = None, builtin: dict[str, int] | None = None, path: str = TOKENIZER, limits: dict[str, float] = LIMITS
) -> DataFrame:
    """(number, gate, hard, passed, metric): the eleven gates of a tokenizer, from ``scan_counts``.

    Hard are 1 round trip, 2 unknown tokens, 3 reserved names and 6 links; 4 fertility, 5 byte tokens, 8 characters per token and 10 use of the
    vocabulary warn; 7 vocabulary, 9 lengths (the 99th percentile) and 11 frequencies (share of rare ids among used ones) only report. No record is no
    round trip; a source outside the range of fertility or below the characters per token fails its gate.
    """
    spark = counts.sparkSession
    size = float(_processor(path).get_piece_size())
    counts = materialize(counts, "scan-counts")
    by = counts.filter("kind = 'sum'").groupBy("source").pivot("key", ["records", "ok", "tokens", "words", "chars", "unk", "byte_tokens"]).agg(F.sum("n"))
    per = lambda a, b: F.try_divide(F.col(a), F.col(b))
    fertility, chars = F.round(per("tokens", "words"), 4), F.round(per("chars", "tokens"), 4)
    sums = by.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "ok", "tokens", "words", "chars", "unk", "byte_tokens")],
        F.count(F.when(~fertility.between(limits["fertility_low"], limits["fertility_high"]), 1)).alias("off"), F.count(F.when(chars < limits["chars_per_token"], 1)).alias("thin"),
    )
    ids = counts.filter("kind = 'id'").agg(F.count(F.lit(1)).alias("used"), F.count(F.when(F.col("n") <= limits["rare"], 1)).alias("rare"))
    links = counts.agg(F.count(F.when(F.col("kind") == "bad_link", 1)).alias("bad_links"))
    lengths = counts.filter("kind = 'length'").agg(F.expr("percentile(cast(key as bigint), 0.99, n)").alias("p99"))
    s = sums.crossJoin(ids).crossJoin(links).crossJoin(lengths)  # one row each
    enough = F.col("tokens") >= limits["tokens_per_slot"] * size
    rows = [
        (1, "round_trip", True, (F.col("records") > 0) & (F.col("ok") == F.col("records")), F.col("records") - F.col("ok")),
        (2, "unknown", True, F.col("unk") == 0, F.col("unk")),
        (4, "fertility", False, F.col("off") == 0, per("tokens", "words")),
        (5, "byte_tokens", False, F.coalesce(per("byte_tokens", "tokens"), F.lit(0.0)) <= limits["byte_share"], per("byte_tokens", "tokens")),
        (6, "links", True, F.col("bad_links") == 0, F.col("bad_links")),
        (8, "chars_per_token", False, F.col("thin") == 0, per("chars", "tokens")),
        (9, "lengths", False, F.lit(True), F.col("p99")),
        (10, "utilization", False, ~enough | (F.col("used") >= limits["utilization"] * size), F.col("used") / size),
        (11, "frequencies", False, F.lit(True), per("rare", "used")),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(g).alias("gate"), F.lit(h).alias("hard"), p.alias("passed"), F.round(m.cast("double"), 6).alias("metric")) for n, g, h, p, m in rows])
    return s.select(F.explode(each).alias("r")).select("r.*").unionByName(spark.createDataFrame(model_gates(specials or {}, builtin or {}, path), "number int, gate string, hard boolean, passed boolean, metric double"))


# ------------------------------------------------------------------ segmentation with given pieces
def viterbi(text: str, pieces: dict[str, float], unknown: float = -20.0, longest: int | None = None) -> list[str]:
    """The segmentation of the highest total score; a code point without a piece is unknown, neighbouring unknowns are one."""
    longest = longest or max(map(len, pieces), default=1)
    best = [0.0] + [-math.inf] * len(text)
    back = [0] * (len(text) + 1)
    known = [False] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            s = pieces.get(text[start:end])
            score = best[start] + (s if s is not None else unknown if end - start == 1 else -math.inf)
            if score > best[end]:
                best[end], back[end], known[end] = score, start, s is not None
    out: list[str] = []
    flags: list[bool] = []
    at = len(text)
    while at:
        start = back[at]
        if out and not known[at] and not flags[-1]:
            out[-1] = text[start:at] + out[-1]
        else:
            out.append(text[start:at])
            flags.append(known[at])
        at = start
    return out[::-1]


def with_bytes(segments: list[str], pieces: dict[str, float]) -> list[str]:
    """Segments without a piece as the byte pieces <0x..> of their UTF-8 form, where the vocabulary has all of these; otherwise they stay unknown."""
    out: list[str] = []
    for x in segments:
        spelled = [f"<0x{b:02X}>" for b in x.encode()]
        out += [x] if x in pieces or not all(b in pieces for b in spelled) else spelled
    return out


def compare_vocabularies(a: DataFrame, b: DataFrame) -> DataFrame:
    """(piece, id_a, id_b) where two vocabularies (piece, id) differ; empty when they are equal id for id."""
    j = a.select("piece", F.col("id").alias("id_a")).join(b.select("piece", F.col("id").alias("id_b")), "piece", "full")
    return j.filter(~F.col("id_a").eqNullSafe(F.col("id_b")))


def compare_encodings(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of rows whose two sequences are equal, equal as multisets, or different."""
    state = F.when(F.col(a).eqNullSafe(F.col(b)), "equal").when(F.array_sort(a).eqNullSafe(F.array_sort(b)), "same_tokens").otherwise("different")
    return df.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def banned_next(tokens: str, n: int):
    """Column: tokens that would complete a run of n tokens already in the array; empty for shorter arrays."""
    c = F.col(tokens)

    def build(a):
        tail = F.slice(a, F.size(a) - n + 2, n - 1)
        starts = F.filter(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, n - 1) == tail)
        return F.when(F.size(a) >= n, F.array_distinct(F.transform(starts, lambda i: F.element_at(a, i + n - 1)))).otherwise(F.slice(a, 1, 0))

    return T.let(c, build)

"""Records to chunks."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T

MAX_CHARS, MIN_CHARS = 3000, 20
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
PARAGRAPH = re.compile(r"\n\s*\n")


def pack(parts: list[str], joint: str, limit: int) -> list[str]:
    """Neighbouring parts joined as long as they stay within the limit; a part that is too long stands alone."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(joint) + len(p) <= limit:
            out[-1] += joint + p
        else:
            out.append(p)
    return out


def chunk_text(text: str, limit: int = MAX_CHARS) -> list[str]:
    """Whole, or packed by paragraphs, or by sentences, or cut hard; chunks under MIN_CHARS are dropped, the last slice of a cut too."""
    chunks = [text]
    if len(text) > limit:
        chunks = []
        for block in pack(PARAGRAPH.split(text), "\n\n", limit):
            sentences = [block] if len(block) <= limit else pack(SENTENCE_END.split(block), " ", limit)
            chunks += [x[k : k + limit] for x in sentences for k in range(0, len(x), limit)]
    return [c for c in chunks if len(c) >= MIN_CHARS]


try:
    from ftfy import fix_text as repair_mojibake
except ImportError:
    #: Without the optional library, encodings are left as they are and no pass over the texts is made for them.
    repair_mojibake = None


def clean_records(df: DataFrame, id_col: str, text_col: str, strip_markup: bool = False, limit: int = MAX_CHARS, repair: Callable[[str], str] | None = repair_mojibake) -> DataFrame:
    """(id, chunk_no, text): repair, markup, image texts, white space, furniture lines, chunks, in this order.

    Repair comes first and always, with markup or without. Null and short texts give no chunk. Only repair, chunking and
    entities beyond the built-in list need Python; all else stays in the JVM.
    """
    cleaned = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("text"))
    if repair:
        cleaned = cleaned.withColumn("text", F.pandas_udf(lambda s: s.map(repair), "string")("text"))
    tidy = T.strip(T.drop_boilerplate(T.normalize_whitespace(T.blank_alt(F.col("text")))))
    schema = cleaned.select(id_col).schema.add("chunk_no", "integer").add("text", "string")

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(html.unescape)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, x) for i, t in zip(pdf[id_col], pdf.text) for k, x in enumerate(chunk_text(t, limit))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "text"])

    if strip_markup:
        bare = F.regexp_replace(F.regexp_replace("text", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "), r"<[^>]+>", " ")
        cleaned = cleaned.withColumn("text", decode(bare))
    return cleaned.select(id_col, tidy.alias("text")).filter(F.length("text") >= MIN_CHARS).mapInPandas(chunks, schema)

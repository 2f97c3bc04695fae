"""Training examples as array columns: span plans, corruption, padding, batches, packing."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import windows
from loomtext.plans.lineage import broadcast_if_small, materialize

# Ids of the framing tokens; sentinel k is FIRST_SENTINEL - k.
EOS, PAD, START, LABEL_PAD = 1, 0, 0, -100
MODES = {"R": 701, "X": 702, "S": 703}
FIRST_SENTINEL, SENTINELS = 33_700, 256
STYLE, OPEN, CLOSE = 262, 274, 275
RATES = {"R": (0.15, 3.0), "X": (0.50, 32.0)}


def ints(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values]) if values else F.array().cast("array<int>")


def special_table(sentinels: list[int], modes: dict[str, int], eos: int, pad: int) -> dict[str, int]:
    """name -> id; a repeated id or name is refused."""
    out = {f"sentinel_{k}": v for k, v in enumerate(sentinels)} | {f"mode_{k}": v for k, v in modes.items()} | {"eos": eos, "pad": pad}
    if len(set(out.values())) != len(out):
        raise ValueError("special tokens share an id")
    return out


def span_plan(length: Column, rate: Column, mean: Column) -> tuple[Column, Column]:
    """(corrupted, spans) of a length: rounded half to even, kept within what the length allows."""
    corrupted = F.greatest(F.lit(1), F.least(F.bround(length * rate).cast("int"), length - 1)).cast("int")
    spans = F.greatest(F.lit(1), F.least(F.bround(corrupted / mean).cast("int"), corrupted, length - corrupted)).cast("int")
    return corrupted, spans


def even_spans(length: Column, corrupted: Column, spans: Column) -> Column:
    """Evenly spaced, never adjacent spans as array<struct<s, e>> (half-open): the draw-free form."""
    width = F.floor(length / spans).cast("int")
    size = F.greatest(F.lit(1), F.least(F.floor(corrupted / spans).cast("int"), width - 1))
    return F.transform(F.sequence(F.lit(0), spans - 1), lambda k: F.struct((k * width + width - size).cast("int").alias("s"), (k * width + width).cast("int").alias("e")))


def prefix_length(length: Column, u: Column, low: float = 0.25, high: float = 0.75) -> Column:
    return F.greatest(F.lit(1), F.least((length * (low + u * (high - low))).cast("int"), length - 1)).cast("int")


def corrupt(tokens: Column, spans: Column, mode: int) -> Column:
    """struct(encoder, target, decoder): kept tokens with a sentinel for every span, and the spans behind their sentinels."""

    def body(sp: Column) -> Column:
        sentinel = lambda k: (F.lit(FIRST_SENTINEL) - k).cast("int")
        until = lambda k: F.when(k == 0, 0).otherwise(F.element_at(sp, k)["e"])
        kept = F.flatten(F.transform(sp, lambda x, k: F.concat(F.slice(tokens, until(k) + 1, x["s"] - until(k)), F.array(sentinel(k)))))
        last = F.element_at(sp, -1)["e"]
        encoder = F.concat(ints(mode), kept, F.slice(tokens, last + 1, F.greatest(F.size(tokens) - last, F.lit(0))), ints(EOS))
        target = F.concat(F.flatten(F.transform(sp, lambda x, k: F.concat(F.array(sentinel(k)), F.slice(tokens, x["s"] + 1, x["e"] - x["s"])))), ints(EOS))
        return F.struct(encoder.alias("encoder"), target.alias("target"), shift(target).alias("decoder"))

    return T.let(spans, body)


def shift(target: Column) -> Column:
    """Decoder input: the start token and the target without its last token."""
    return F.concat(ints(START), F.slice(target, 1, F.greatest(F.size(target) - 1, F.lit(0))))


def prefix_example(tokens: Column, prefix: Column) -> Column:
    target = F.concat(F.slice(tokens, prefix + 1, F.size(tokens) - prefix), ints(EOS))
    return F.struct(F.concat(ints(MODES["S"]), F.slice(tokens, 1, prefix), ints(EOS)).alias("encoder"), target.alias("target"), shift(target).alias("decoder"))


def frame(source: Column, target: Column) -> Column:
    """Style, open, source, close, end -> target, end; null when a control token stands in the source."""
    control = F.arrays_overlap(source, ints(STYLE, OPEN, CLOSE, EOS))
    out = F.struct(F.concat(ints(STYLE, OPEN), source, ints(CLOSE, EOS)).alias("encoder"), F.concat(target, ints(EOS)).alias("target"))
    return F.when(~control, out)


def reconstruct(encoder: list[int], target: list[int]) -> list[int]:
    """The tokens that an example was made from: spans put back where their sentinels stand."""
    spans: dict[int, list[int]] = {}
    at = None
    for t in target[:-1]:
        if FIRST_SENTINEL - SENTINELS < t <= FIRST_SENTINEL:
            at = t
            spans[at] = []
        else:
            spans[at].append(t)
    out: list[int] = []
    for t in encoder[1:-1]:
        out += spans[t] if t in spans else [t]
    return out


def sample_spans(length: int, rate: float, mean: float, rng: random.Random, most: int = SENTINELS) -> list[tuple[int, int]]:
    """Spans that alternate with kept stretches, lengths drawn as random compositions; never adjacent."""
    corrupted = max(1, min(round(length * rate), length - 1))
    n = max(1, min(round(corrupted / mean), corrupted, length - corrupted, most))

    def bits(total: int) -> list[int]:
        cuts = sorted(rng.sample(range(1, total), n - 1))
        return [b - a for a, b in zip([0, *cuts], [*cuts, total])]

    out, at = [], 0
    for kept, cut in zip(bits(length - corrupted), bits(corrupted)):
        out.append((at + kept, at + kept + cut))
        at += kept + cut
    return out


def seeded(seed: int, index: int) -> random.Random:
    """The same generator for an index on any machine."""
    import hashlib

    return random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{index}".encode()).digest()[:8], "big"))


def sampled_examples(df: DataFrame, pos: str, tokens: str, mode: Column, seed: int = 17, low: int = 8, high: int = 512) -> DataFrame:
    """(pos, mode, skip, encoder, target, n_spans): admission by length, then the objective of the mode.

    Lengths out of range and unknown modes are skipped with a reason; rows without a position are left out. Every row has its own generator.
    """
    schema = f"{pos} long, mode string, skip string, encoder array<int>, target array<int>, n_spans int"

    def build(p: int, t: list[int], m: str) -> tuple:
        n = len(t) if t is not None else 0
        m = m if isinstance(m, str) else None
        if n < low or n > high:
            return p, m, "too_short" if n < low else "too_long", None, None, 0
        if m not in MODES:
            return p, m, "unknown_mode", None, None, 0
        t, rng = [int(x) for x in t], seeded(seed, p)
        if m == "S":
            k = max(1, min(int(n * rng.uniform(0.25, 0.75)), n - 1))
            return p, m, None, [MODES["S"], *t[:k], EOS], [*t[k:], EOS], 0
        spans = sample_spans(n, *RATES[m], rng)
        enc, tgt, at = [MODES[m]], [], 0
        for k, (a, b) in enumerate(spans):
            enc += [*t[at:a], FIRST_SENTINEL - k]
            tgt += [FIRST_SENTINEL - k, *t[a:b]]
            at = b
        return p, m, None, [*enc, *t[at:], EOS], [*tgt, EOS], len(spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([build(int(p), t, m) for p, t, m in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], pdf.iloc[:, 2])], columns=[pos, "mode", "skip", "encoder", "target", "n_spans"])

    return df.filter(F.col(pos).isNotNull()).select(pos, tokens, mode.alias("_mode")).mapInPandas(run, schema)


def pad_to(arr: Column, width: Column, value: int) -> Column:
    return F.concat(arr, F.array_repeat(F.lit(value).cast("int"), F.greatest(width - F.size(arr), F.lit(0)).cast("int")))


def pad_batches(df: DataFrame, batch: str, enc: str, target: str, multiple: int = 8) -> DataFrame:
    """Arrays padded to the widest of their batch, rounded up; masks; labels padded with LABEL_PAD.

    The widths are one small aggregate per batch, joined back; the arrays themselves are not sorted.
    """
    up = lambda c: (F.ceil(c / multiple) * multiple).cast("int")
    widths = df.groupBy(batch).agg(up(F.max(F.size(enc))).alias("_we"), up(F.max(F.size(target))).alias("_wt"))
    j = df.join(widths, batch)
    mask = F.concat(F.transform(enc, lambda x: F.lit(1)), F.array_repeat(F.lit(0), F.greatest(F.col("_we") - F.size(enc), F.lit(0))))
    return j.withColumn("attention_mask", mask).withColumn(enc, pad_to(F.col(enc), F.col("_we"), PAD)).withColumn(target, pad_to(F.col(target), F.col("_wt"), LABEL_PAD)).drop("_we", "_wt")


def strip_pad(name: str, pad: int) -> Column:
    """The array without the padding at its right end."""
    return F.expr(f"slice(`{name}`, 1, coalesce(array_max(transform(`{name}`, (x, i) -> if(x <> {pad}, i + 1, 0))), 0))")


def length_batches(df: DataFrame, pos: str, by: str, size: Column, rows: int = 16, pool: int = 256) -> DataFrame:
    """Adds pool_no, batch_no: inside pools of ``pool`` positions rows are ordered by size and cut into batches of ``rows``."""
    pooled = df.withColumn("pool_no", F.floor(F.col(pos) / pool).cast("int")).withColumn("_size", size)
    order = Window.partitionBy(by, "pool_no").orderBy("_size", pos)
    return pooled.withColumn("batch_no", F.floor((F.row_number().over(order) - 1) / rows).cast("int")).drop("_size")


def capacity_batches(df: DataFrame, pos: str, by: str, enc: str, target: str, enc_cells: int, target_cells: int, most: int = 64, pool: int = 256) -> DataFrame:
    """(pos, by, pool_no, batch_no): rows by size, cut where rows times the padded width would exceed a capacity on either side.

    Pools are bounded, so each group is.
    """
    schema = df.select(pos, by).schema.add("pool_no", "integer").add("batch_no", "integer")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(m=pdf[[enc, target]].max(axis=1)).sort_values(["m", enc, pos])
        numbers, n, we, wt, k = [], 0, 0, 0, 0
        for e, t in zip(pdf[enc], pdf[target]):
            we2, wt2 = max(we, e), max(wt, t)
            if n and ((n + 1) * we2 > enc_cells or (n + 1) * wt2 > target_cells or n == most):
                k, n, we2, wt2 = k + 1, 0, e, t
            n, we, wt = n + 1, we2, wt2
            numbers.append(k)
        return pdf.assign(batch_no=numbers)[[pos, by, "pool_no", "batch_no"]]

    pooled = df.select(pos, by, enc, target, F.floor(F.col(pos) / pool).cast("int").alias("pool_no"))
    return pooled.groupBy(by, "pool_no").applyInPandas(cut, schema)


#: Blocks whose plan is broadcast; more of them are joined by a shuffle.
MOST_BLOCKS = 1_000_000
#: Documents of a block in which windows are laid out by one task.
WINDOW_BLOCK = 50_000


def pack_windows(df: DataFrame, pos: str, by: str, length: str, budget: int, most: int, block: int | None = None) -> DataFrame:
    """(pos, by, window_no, segment): documents in order of ``pos`` while length + 2 fits the window and there are not too many; at least one.

    One sequence per value of ``by``, however long: documents are ranked in two levels and cut into blocks. Wherever a window may
    enter a block (at one of its first ``most`` documents) the block says where it leaves it and after how many windows; these
    few rows are composed in order, and then every block lays out the windows that begin in it. Rows without a position or a
    length are in no window.
    """
    size = max(WINDOW_BLOCK if block is None else block, most)
    ranked = windows.ranked(df.filter(F.col(pos).isNotNull() & F.col(length).isNotNull()).select(pos, by, length), [by], pos, size)
    own = F.floor(F.col("__rank") / size)
    # the first documents of a block also end windows of the block before
    both = F.when((F.col("__rank") >= size) & (F.pmod(F.col("__rank"), F.lit(size)) < most), F.array(own - 1, own)).otherwise(F.array(own))
    rows = materialize(ranked.withColumn("_block", F.explode(both)), "window-blocks")

    def ends(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[int], int]:
        """The documents in order, where a window that begins at each of them ends, and how many are the block's own."""
        pdf = pdf.sort_values("__rank")
        need = [int(x) + 2 for x in pdf[length]]
        out, end, used = [], 0, 0
        for start in range(len(need)):
            if end <= start:
                end, used = start + 1, need[start]
            while end < len(need) and end - start < most and used + need[end] <= budget:
                used, end = used + need[end], end + 1
            out.append(end)
            used -= need[start]
        return pdf, out, int((pdf["__rank"] // size == pdf["_block"]).sum())

    def leave(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, end, mine = ends(pdf)
        exits = {}
        for start in range(mine - 1, -1, -1):
            at, n = exits.get(end[start], (end[start] - mine, 0))
            exits[start] = (at, n + 1)
        entries = range(min(most + 1, mine))
        return pd.DataFrame({by: key[0], "_block": key[1], "entry": list(entries), "leaves": [exits[k][0] for k in entries], "n": [exits[k][1] for k in entries]})

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        steps = {(b, e): (x, n) for b, e, x, n in zip(pdf["_block"], pdf["entry"], pdf["leaves"], pdf["n"])}
        out, at, first = [], 0, 0
        for b in sorted(set(pdf["_block"])):
            out.append((key[0], b, at, first))
            leaves, n = steps.get((b, at), (0, 0))
            at, first = leaves, first + n
        return pd.DataFrame(out, columns=[by, "_block", "_enters", "_first"])

    kind = df.schema[by].dataType.simpleString()
    table = rows.groupBy(by, "_block").applyInPandas(leave, f"{by} {kind}, _block long, entry long, leaves long, n long")
    plan = materialize(table.groupBy(by).applyInPandas(compose, f"{by} {kind}, _block long, _enters long, _first long"), "window-plan")

    def lay_out(pdf: pd.DataFrame) -> pd.DataFrame:
        enters, number = int(pdf["_enters"].iloc[0]), int(pdf["_first"].iloc[0])
        pdf, end, mine = ends(pdf)
        out, start = [], enters
        while start < mine:
            out += [(number, k + 1) for k in range(end[start] - start)]
            start, number = end[start], number + 1
        return pdf[[pos, by]].iloc[enters : enters + len(out)].assign(window_no=[a for a, _ in out], segment=[b for _, b in out])

    same = [F.col(f"l.{by}").eqNullSafe(F.col(f"r.{by}")), F.col("l._block") == F.col("r._block")]
    planned = rows.alias("l").join(broadcast_if_small(plan, MOST_BLOCKS).alias("r"), same).select("l.*", "r._enters", "r._first")
    schema = df.select(pos, by).schema.add("window_no", "long").add("segment", "integer")
    return planned.groupBy(by, "_block").applyInPandas(lay_out, schema)


def epoch_plan(df: DataFrame, pos: str, size: str, seed: str, window_rows: int = 64, step_rows: int = 8) -> DataFrame:
    """(pos, epoch_window, step): an epoch shuffled by draw into windows of about ``window_rows`` rows, each ordered by size and cut into steps.

    Another ``seed`` is another epoch. A window is small, so no task holds more than a few of them.
    """
    n = max(1, -(-df.count() // window_rows))
    rows = df.select(pos, size, F.floor(T.uniform(F.lit(seed), F.col(pos)) * n).cast("int").alias("epoch_window"))
    order = Window.partitionBy("epoch_window").orderBy(size, pos)
    return rows.select(pos, "epoch_window", F.floor((F.row_number().over(order) - 1) / step_rows).cast("int").alias("step"))


def produced(df: DataFrame, columns: list[str], make: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Examples from a producer of the user's own: ``make`` turns a row (as a dict) into any number of examples (dicts by the schema's names).

    Whatever makes them, the result can be batched by length, by capacity or packed like any other.
    """
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [[x.get(n) for n in names] for row in pdf.to_dict("records") for x in make(row)]
            yield pd.DataFrame(out, columns=names)

    return df.select(*columns).mapInPandas(run, schema)


def packed_examples(df: DataFrame, pos: str, by: str, tokens: str, budget: int, most: int, seed: int = 17) -> DataFrame:
    """(by, window_no, documents, encoder, segments, target, target_segments): the documents of every window as one example.

    ``by`` is the mode; windows are those of ``pack_windows``, each with a generator of its own, so no partitioning changes them. Modes without
    rates of corruption (prefixes) and null modes are left out.
    """
    rows = df.filter(F.col(by).isin(list(RATES)) & (F.size(tokens) >= 2)).select(pos, by, tokens)
    laid = pack_windows(rows.withColumn("_n", F.size(tokens)), pos, by, "_n", budget, most)
    kind = df.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, window_no long, documents array<long>, encoder array<int>, segments array<int>, target array<int>, target_segments array<int>"

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        x = packed_example([[int(t) for t in ids] for ids in pdf[tokens]], key[0], seeded(seed, int(pdf[pos].iloc[0])))
        return pd.DataFrame({by: [key[0]], "window_no": [key[1]], "documents": [pdf[pos].tolist()], **{k: [v] for k, v in x.items()}})

    # a window holds at most ``most`` documents
    return laid.join(rows.select(pos, tokens), pos).groupBy(by, "window_no").applyInPandas(build, schema)


def packed_example(documents: list[list[int]], mode: str, rng: random.Random) -> dict:
    """One window of several documents: sentinels run on, segment ids start at 1."""
    enc, seg, tgt, tseg, k = [MODES[mode]], [1], [], [], 0
    for s, t in enumerate(documents, 1):
        at = 0
        for a, b in sample_spans(len(t), *RATES[mode], rng, max(1, SENTINELS - k)):
            enc += [*t[at:a], FIRST_SENTINEL - k]
            tgt += [FIRST_SENTINEL - k, *t[a:b]]
            at, k = b, k + 1
        enc += t[at:]
        seg += [s] * (len(enc) - len(seg))
        tseg += [s] * (len(tgt) - len(tseg))
    return {"encoder": [*enc, EOS], "segments": [*seg, len(documents)], "target": [*tgt, EOS], "target_segments": [*tseg, len(documents)]}


def example_json(df: DataFrame) -> Column:
    """Canonical JSON of a row; null fields are left out."""
    return F.to_json(F.struct(*df.columns))


def parse_example(text: str) -> dict:
    return json.loads(text)

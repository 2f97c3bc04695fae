"""Masking by patterns: addresses, handles and phone numbers become invented ones of the same shape."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.operators.blend import numbered, prefix_sums
from loomtext.plans.lineage import materialize, small_rows

EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]*\w@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])")
MENTION = re.compile(r"(?<![\w@/.`])@(?![\w.-]+/)[A-Za-z]\w{1,30}\b")
PHONE = re.compile(r"(?<![\w.+/-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ ./-]\d{2,5}){1,4}(?![\w/-])")
#: Forms without look-around, for counting in any engine.
EMAIL_SIMPLE = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z]"
MENTION_SIMPLE = r"[ (]@[A-Za-z][A-Za-z0-9_]+"
PROTECTED = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|<https?://[^>]*>|\]\([^)\s]*\)|https?://\S+|(?m:^(?: {4}|\t).*$)", re.S)


def protected_spans(text: str) -> list[tuple[int, int]]:
    """Merged stretches that are never changed: fences, code, links, indented lines."""
    out: list[list[int]] = []
    for a, b in sorted(m.span() for m in PROTECTED.finditer(text)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def is_phone(s: str) -> bool:
    """7 to 15 digits, no date, not only groups between dots."""
    digits = sum(c.isdigit() for c in s)
    return 7 <= digits <= 15 and not re.fullmatch(r"\d{4}[-./]\d\d[-./]\d\d", s) and not re.fullmatch(r"\d+(?:\.\d+)+", s)


class Allocator:
    """index -> identity: an affine bijection, then mixed radix (first, last, style, suffix, domain)."""

    # Pools of invented names (no two first and no two last names share an initial) and reserved example domains.
    first = ["ada", "ben", "cleo", "dara", "emil", "fern", "gil", "hana", "ian", "jo", "kai", "lena", "milo", "nia", "omar", "pia", "quin", "ruth", "sven", "tara"]
    last = ["abel", "birch", "crane", "dale", "elm", "frost", "grove", "heath", "ivens", "jarvis", "keel", "lark", "moor", "north", "oaks", "pike", "quill", "reed", "stone", "thorn", "vale", "wells"]
    domains = ["mail.example", "post.example", "inbox.example", "letters.example", "home.example"]
    # The shapes of local parts and of handles; {f} and {l} stand for the names, {a} and {b} for their initials, capitals for capitalised ones.
    email_styles = ["{f}.{l}", "{a}{l}", "{f}{b}", "{f}_{l}", "{l}.{f}"]
    handle_styles = ["{F}{L}", "{F}_{L}", "{A}{L}", "{F}{B}", "{F}.{L}", "{f}{l}"]

    def __init__(self, salt: int = 0, suffixes: int = 1000, initials: int = 0):
        self.suffixes, self.initials = suffixes, initials
        people = len(self.first) * len(self.last)
        self.size = people * len(self.email_styles) * suffixes * len(self.domains)
        #: Handles have no domain.
        self.handles = people * len(self.handle_styles) * suffixes
        #: Names have no suffix: their number grows by initials between the names.
        self.names = people * 26**initials
        a = 48_271 + salt
        while math.gcd(a, self.size * self.handles * self.names) != 1:
            a += 1
        self.multiplier, self.offset = a, salt * 40_503

    @classmethod
    def holding(cls, wanted: int) -> Allocator:
        """The smallest pools with at least ``wanted`` addresses and handles."""
        made = cls()
        while min(made.size, made.handles) < wanted:
            made = cls(suffixes=made.suffixes * 10)
        return made

    @classmethod
    def naming(cls, wanted: int) -> Allocator:
        """The fewest initials that give ``wanted`` different names."""
        made = cls()
        while made.names < wanted:
            made = cls(initials=made.initials + 1)
        return made

    def scrambled(self, index: int, size: int) -> int:
        return (index % size * self.multiplier + self.offset) % size

    def _shaped(self, x: int, styles: list[str]) -> str:
        x, suffix = divmod(x, self.suffixes)
        x, style = divmod(x, len(styles))
        f, n = self.first[x // len(self.last)], self.last[x % len(self.last)]
        return styles[style].format(f=f, l=n, a=f[0], b=n[0], F=f.title(), L=n.title(), A=f[0].upper(), B=n[0].upper()) + str(suffix or "")

    def handle(self, index: int) -> str:
        return "@" + self._shaped(self.scrambled(index, self.handles), self.handle_styles)

    def email(self, index: int) -> str:
        x, d = divmod(self.scrambled(index, self.size), len(self.domains))
        return f"{self._shaped(x, self.email_styles)}@{self.domains[d]}"


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _div(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("long")


def _shaped(x: Column, a: Allocator, styles: list[str]) -> Column:
    """The same shapes in whole-number arithmetic of the JVM."""
    suffix, x = F.pmod(x, F.lit(a.suffixes)), _div(x, a.suffixes)
    style, x = F.pmod(x, F.lit(len(styles))), _div(x, len(styles))
    f, n = _pick(a.first, _div(x, len(a.last))), _pick(a.last, F.pmod(x, F.lit(len(a.last))))
    values = {"f": f, "l": n, "a": F.substring(f, 1, 1), "b": F.substring(n, 1, 1)}
    values |= {k.upper(): F.initcap(v) for k, v in values.items()}
    out = F.lit(None).cast("string")
    for k, shape in enumerate(styles):
        parts = [values[p[1]] if p[0] == "{" else F.lit(p) for p in re.findall(r"\{\w\}|[^{}]+", shape)]
        out = F.when(style == k, F.concat(*parts)).otherwise(out)
    return F.concat(out, F.when(suffix == 0, "").otherwise(suffix.cast("string")))


def _scrambled(index: Column, a: Allocator, size: int) -> Column:
    return F.pmod(F.pmod(index, F.lit(size)) * a.multiplier + a.offset, F.lit(size)).cast("long")


def identities(df: DataFrame, index: str, allocator: Allocator | None = None) -> DataFrame:
    """Adds name, email and handle of every index; each is different for different indices below ``names``, ``size`` and ``handles``."""
    a = allocator or Allocator()
    i = F.col(index)
    x, y, z = _scrambled(i, a, a.size), _scrambled(i, a, a.handles), _scrambled(i, a, a.names)
    initials, people = [], z
    for _ in range(a.initials):
        initials.append(F.concat(F.char(F.pmod(people, F.lit(26)) + 65), F.lit(".")))
        people = _div(people, 26)
    name = F.concat_ws(" ", F.initcap(_pick(a.first, _div(people, len(a.last)))), *initials, F.initcap(_pick(a.last, F.pmod(people, F.lit(len(a.last))))))
    email = F.concat(_shaped(_div(x, len(a.domains)), a, a.email_styles), F.lit("@"), _pick(a.domains, F.pmod(x, F.lit(len(a.domains)))))
    return df.withColumn("name", name).withColumn("email", email).withColumn("handle", F.concat(F.lit("@"), _shaped(y, a, a.handle_styles)))


def phone_digits(index: Column, n: int) -> Column:
    """n digits (up to 9) from a number by an affine map modulo 10^n."""
    return F.lpad(F.pmod(index * F.lit(862_933) + F.lit(442_695), F.lit(10**n)).cast("string"), n, "0")


def reserve(counts: DataFrame, key: str, wanted: str, start: int = 0) -> DataFrame:
    """Adds first_index: ranges [first_index, first_index + wanted) follow one another by key. For small tables."""
    return counts.withColumn("first_index", (F.sum(wanted).over(Window.partitionBy().orderBy(key)) - F.col(wanted) + start).cast("long"))


#: Layers of numbers that a value may fall back to when it is reserved.
LAYERS = 16


def mask_text(text: str, base: int, allocator: Allocator) -> tuple[str, dict[str, int]]:
    """One text: addresses, then handles, then phones; what is equal before is equal after. Protected stretches stay."""
    return _mask(text, base, allocator)[:2]


def _mask(text: str, base: int, allocator: Allocator, total: int = 0, reserved: frozenset[str] = frozenset()) -> tuple[str, dict[str, int], int]:
    """mask_text, and how many different items the text has; they take the numbers from ``base`` on.

    All texts together take ``total`` numbers. A number whose value is reserved is left out for the
    one ``total`` further on, which no other item can take.
    """
    seen: dict[str, str] = {}
    counts = {"emails": 0, "mentions": 0, "phones": 0}

    def swap(kind: str, pattern: re.Pattern, make) -> None:
        nonlocal text
        keep = protected_spans(text)

        def one(m: re.Match) -> str:
            s = m.group()
            if any(a < m.end() and m.start() < b for a, b in keep) or kind == "phones" and not is_phone(s):
                return s
            counts[kind] += 1
            if s not in seen:
                index = base + len(seen)
                seen[s] = next((v for k in range(LAYERS) if (v := make(s, index + k * total)) not in reserved), None)
                if seen[s] is None:
                    raise ValueError(f"number {index} has only reserved values")
            return seen[s]

        text = pattern.sub(one, text)

    swap("emails", EMAIL, lambda s, i: allocator.email(i))
    swap("mentions", MENTION, lambda s, i: allocator.handle(i))
    swap("phones", PHONE, _same_shape)
    return text, counts, len(seen)


def _same_shape(s: str, index: int) -> str:
    """The leading group stays, the other digits are replaced; separators stay where they are."""
    head = re.match(r"\+?\(?\d+", s).end()
    n = sum(c.isdigit() for c in s[head:])
    new = iter(str((index * 2_862_933_555_777_941_757 + 1_442_695_040_888_963_407) % 10**n).zfill(n)) if n else iter("")
    return s[:head] + "".join(next(new) if c.isdigit() else c for c in s[head:])


#: Requests that are served at once.
MAX_REQUESTS = 1_000_000
#: Reserved values that every worker may hold.
MAX_RESERVED = 1_000_000


def mask_documents(df: DataFrame, pos: str, text: str, reserved: DataFrame | None = None, first_index: int = 0) -> DataFrame:
    """(pos, text, emails, mentions, phones). Null stays null; ``pos`` is unique.

    The different items of every text are counted first. Prefix sums of the counts give every text
    a range of numbers of its own, so that no two items of the table share an address or a handle, and any
    partitioning gives the same result; the pools grow with the total. Phone numbers keep their length and
    leading group: numbers too short for the total are given out again.
    ``reserved`` (value) holds values that are never given out; numbers start at ``first_index`` (``reserve_ranges``).
    """
    keep = df.select(pos).schema
    taken = frozenset(r[0] for r in small_rows(reserved.select("value").filter("value is not null").distinct(), MAX_RESERVED, "reserved values")) if reserved is not None else frozenset()
    some = Allocator()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({pos: pdf[pos], "__text": pdf[text], "__items": [_mask(t, 0, some)[2] if isinstance(t, str) else 0 for t in pdf[text]]})

    counted = materialize(df.select(pos, text).mapInPandas(count, StructType([*keep.fields]).add("__text", "string").add("__items", "long")), "masking-items")
    if not counted.filter(F.col(pos).isNull() & (F.col("__items") > 0)).isEmpty():
        raise ValueError("a text without a position cannot be given numbers")
    total = counted.agg(F.coalesce(F.sum("__items"), F.lit(0))).first()[0]
    allocator = Allocator.holding(first_index + total * (LAYERS if taken else 1))
    # only texts with items are moved
    ranged = prefix_sums(counted.filter("__items > 0"), pos, "__items", "__base").unionByName(counted.filter("__items = 0").withColumn("__base", F.lit(0).cast("long")))
    schema = StructType([*keep.fields]).add("text", "string")
    for c in ("emails", "mentions", "phones"):
        schema = schema.add(c, "integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, base, items in zip(pdf["__text"], pdf["__base"], pdf["__items"]):
                rows.append(_mask(t, first_index + int(base), allocator, total, taken) if items else (t if isinstance(t, str) else None, {"emails": 0, "mentions": 0, "phones": 0}, 0))
                if rows[-1][2] != items:
                    raise RuntimeError("a text has other items than were counted")
            yield pd.DataFrame({pos: pdf[pos], "text": [r[0] for r in rows], **{c: [r[1][c] for r in rows] for c in ("emails", "mentions", "phones")}})

    return ranged.mapInPandas(run, schema)


def mask_names(df: DataFrame, name: str, first_index: int = 0) -> DataFrame:
    """Replaces a column that is known to hold a person's name by an invented one: one for every different name, the same wherever it
    stands, from index ``first_index`` on. Null and blank names stay."""
    people = numbered(df.filter(F.trim(name) != ""), name, "__n").withColumn("__n", F.col("__n") + first_index)
    made = identities(people, "__n", Allocator.naming(first_index + people.count())).select(F.col(name).alias("__who"), F.col("name").alias("__made"))
    return df.join(made, F.col(name) == F.col("__who"), "left").withColumn(name, F.coalesce("__made", name)).drop("__who", "__made")


def reserve_ranges(requests: DataFrame, registry: str) -> DataFrame:
    """(kind, worker, first_index, wanted): a range of indices for every request (kind, worker, wanted), after all that the registry has given out.

    The registry is a folder of Parquet files in shared storage to which the ranges are appended before they are returned: a range that was
    given out is never given out again, whatever becomes of its worker. Requests are a small table; one process reserves at a time.
    """
    from pyspark.errors import AnalysisException

    spark = requests.sparkSession
    rows = small_rows(requests.select("kind", "worker", F.col("wanted").cast("long")).orderBy("kind", "worker"), MAX_REQUESTS, "requests")
    try:
        high = {r.kind: r.high for r in spark.read.parquet(registry).groupBy("kind").agg(F.max(F.col("first_index") + F.col("wanted")).alias("high")).collect()}
    except AnalysisException:
        high = {}
    out = []
    for kind, worker, wanted in rows:
        out.append((kind, worker, high.get(kind, 0), wanted))
        high[kind] = high.get(kind, 0) + wanted
    given = spark.createDataFrame(out, "kind string, worker string, first_index long, wanted long")
    given.coalesce(1).write.mode("append").parquet(registry)
    return given


def log_issued(issued: DataFrame, kind: str, index: str, value: str, path: str) -> None:
    """Appends (kind, index, value) of what was issued; what it replaced is never written."""
    issued.select(F.lit(kind).alias("kind"), F.col(index).cast("long").alias("index"), F.col(value).alias("value")).write.mode("append").json(path)

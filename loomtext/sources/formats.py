"""Formats that need a state machine per record: posts in XML, command pages, cheat sheets."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import blend, pii


class _Markdown(HTMLParser):
    """The part of HTML that posts use, as Markdown."""

    MARK = {"strong": "**", "b": "**", "em": "_", "i": "_"}
    BREAKS = {"p", "div", "ul", "ol", *(f"h{k}" for k in range(1, 7))}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.pre = False
        self.hrefs: list[str | None] = []
        #: Numbers of the open ordered lists, None for others.
        self.lists: list[int | None] = []
        #: Where the open quotations begin.
        self.quotes: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        get = dict(attrs).get
        if tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else None)
        elif tag == "li":
            n = self.lists[-1] if self.lists else None
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if n is None else f"{n}. "))
            if n is not None:
                self.lists[-1] = n + 1
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        elif tag == "a":
            self.hrefs.append(get("href"))
            self.out.append("[" if get("href") else "")
        elif tag == "img" and get("src"):
            self.out.append(f"![{get('alt') or ''}]({get('src')})")
        elif tag == "blockquote":
            self.quotes.append(len(self.out))
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.MARK:
            self.out.append(self.MARK[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.hrefs:
            href = self.hrefs.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag == "blockquote" and self.quotes:
            at = self.quotes.pop()
            quoted = re.sub(r"\n{3,}", "\n\n", "".join(self.out[at:])).strip()
            self.out[at:] = ["\n\n" + "\n".join(f"> {x}".rstrip() for x in quoted.split("\n")) + "\n\n"]
        elif tag in self.MARK:
            self.out.append(self.MARK[tag])
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in self.BREAKS:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        self.out.append(data)


def html_to_markdown(body: str) -> str:
    """Links and images keep their targets, quotations their marks, code its fences; no line is wrapped."""
    p = _Markdown()
    p.feed(body)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip()


def read_posts(spark: SparkSession, path: str, mask: bool = False, first_index: int = 0) -> DataFrame:
    """(id, text) of the rows of an XML dump: posts' Body as Markdown (never decoded before), comments' Text decoded once.

    With ``mask`` the display name that a row carries is replaced, wherever it stands in its text, by an invented name: one for every
    different person of the dump, from index ``first_index`` of the invented identities on.
    """
    schema = "_Id long, _Body string, _Text string, _DisplayName string, _OwnerDisplayName string"
    rows = spark.read.format("xml").option("rowTag", "row").schema(schema).load(path)
    who = F.coalesce(F.nullif(F.col("_DisplayName"), F.lit("")), F.nullif(F.col("_OwnerDisplayName"), F.lit("")))
    named = rows.select("_Id", "_Body", "_Text", who.alias("_who")).withColumn("_made", F.lit(None).cast("string"))
    if mask:
        people = blend.numbered(named, "_who", "_n").withColumn("_n", F.col("_n") + first_index)
        made = pii.identities(people, "_n", pii.Allocator.naming(first_index + people.count())).select("_who", F.col("name").alias("_made"))
        named = named.drop("_made").join(made, "_who", "left").select("_Id", "_Body", "_Text", "_who", "_made")

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for _, body, text, person, made in pdf.itertuples(index=False):
                t = html_to_markdown(body) if isinstance(body, str) else html.unescape(text) if isinstance(text, str) else ""
                texts.append(t.replace(person, made) if isinstance(made, str) and person.strip() else t)
            yield pd.DataFrame({"id": pdf["_Id"], "text": texts})

    return named.mapInPandas(convert, "id long, text string").filter("trim(text) <> ''")


def command_page(name: str, raw: str) -> str:
    """A page of examples: description lines start with '> ', an example is a line '- what:' and a line in backticks.

    The header is the name, and after a colon the description; every example is its explanation and, on the next line, the command.
    """
    about, examples, what = [], [], ""
    for line in map(str.strip, raw.splitlines()):
        mark, rest = line[:2], line[2:].strip()
        if mark == "> ":
            about.append(rest)
        elif mark == "- ":
            what = rest.rstrip(":")
        elif len(line) > 1 and line[0] == line[-1] == "`" and what:
            examples.append(what + "\n" + line.strip("`"))
            what = ""
    return _sheet(name.replace("-", " "), about, examples)


def cheat_sheet(name: str, raw: str) -> str:
    """Lines after '#' describe and go into the header; runs of other lines between blank ones and descriptions are blocks of commands."""
    lines = [x.strip() for x in raw.splitlines()]
    about = [x.lstrip("#").strip() for x in lines if x.startswith("#")]
    blocks = ["\n".join(run) for ends, run in groupby(lines, lambda x: not x or x.startswith("#")) if not ends]
    return _sheet(name.replace("-", " ").replace("_", " "), [x for x in about if x], blocks)


def _sheet(header: str, about: list[str], blocks: list[str]) -> str:
    """Header and blocks with blank lines between; nothing without a block."""
    return "\n\n".join([": ".join([header, " ".join(about)] if about else [header]), *blocks]) if blocks else ""


def format_records(df: DataFrame, name: str, raw: str, style: str) -> DataFrame:
    """(name, text) of command pages (style "page") or cheat sheets ("sheet"); empty results are dropped."""
    convert = {"page": command_page, "sheet": cheat_sheet}[style]
    schema = df.select(name).schema.add("text", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({name: pdf[name], "text": [convert(str(n), r) for n, r in zip(pdf[name], pdf[raw])]})

    return df.filter(F.col(raw).isNotNull()).select(name, raw).mapInPandas(run, schema).filter("text <> ''")

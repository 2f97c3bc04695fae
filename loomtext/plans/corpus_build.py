"""Multi-step jobs: building a training corpus, freezing evaluation sets, gates, reports, settings."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields
from hashlib import file_digest
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators import blend, examples
from loomtext.plans.lineage import materialize, small_rows
from loomtext.sources import records


#: Share of bytes by which a source may miss its wanted share without a note.
MOST_DEVIATION = 0.02


class CorpusError(RuntimeError):
    """A corpus that must not be used: what was wrong stands in the message."""


@dataclass(frozen=True)
class BuildSettings:
    train_budget: int
    seed: int = 17
    max_line_bytes: int = 4096
    max_drop_fraction: float = 0.05

    @classmethod
    def from_dict(cls, values: dict) -> BuildSettings:
        """Unknown and missing keys, wrong types and values out of range are refused."""
        names = {f.name for f in fields(cls)}
        if unknown := set(values) - names:
            raise CorpusError(f"unknown settings: {sorted(unknown)}")
        if "train_budget" not in values:
            raise CorpusError("train_budget is missing")
        out = cls(**values)
        if not isinstance(out.train_budget, int) or out.train_budget < 1 or not 0 <= out.max_drop_fraction < 1 or out.max_line_bytes < 1:
            raise CorpusError(f"settings out of range: {out}")
        return out


def build_corpus(df: DataFrame, settings: BuildSettings, weights: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines with ``train``, report per source) from (doc_id, source, text).

    Scan, refuse too large a share of dropped lines, share the budget out over sources, choose
    exactly that many lines by draw, and reconcile the counts before anything is returned.
    """
    lines = records.eligible_lines(df, ["doc_id", "source"], limit=settings.max_line_bytes)
    stats = small_rows(records.line_stats(lines, ["source"]), 10_000, "sources")
    kept, lost = sum(r.eligible for r in stats), sum(r.oversized for r in stats)
    if kept + lost and lost / (kept + lost) > settings.max_drop_fraction:
        raise CorpusError(f"{lost} of {kept + lost} lines are too long")
    capacity = {r.source: r.eligible for r in stats if r.source is not None}
    shares = weights or {k: float(n) for k, n in capacity.items()}
    budget = min(settings.train_budget, kept - max(1, kept // 10)) if kept else 0
    quota = blend.allocate(budget, shares, capacity)
    table = df.sparkSession.createDataFrame([(k, n) for k, n in quota.items()] or [("", 0)], "source string, quota long")
    eligible = lines.filter("state = 'eligible'").select("doc_id", "source", "line_no", "line", "n_bytes").join(F.broadcast(table), "source")
    chosen = blend.select_quota(eligible, ["source"], F.col("quota"), F.lit(settings.seed), F.col("doc_id"), F.col("line_no"))
    chosen = materialize(chosen.withColumnRenamed("selected", "train"), "corpus")
    report = chosen.groupBy("source").agg(F.count(F.when(F.col("train"), 1)).alias("trained"), F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.when(F.col("train"), F.col("n_bytes"))), F.lit(0)).alias("bytes"))
    got = {r.source: r.trained for r in small_rows(report, 10_000, "sources")}
    if any(got.get(k, 0) != n for k, n in quota.items()):
        raise CorpusError(f"chosen {got}, wanted {quota}")
    whole = report.agg(F.sum("bytes")).scalar()
    wanted = F.lit(None).cast("double")
    for k, w in (weights or {}).items():
        wanted = F.when(F.col("source") == k, w / sum(weights.values())).otherwise(wanted)
    report = report.withColumn("byte_share", F.round(F.try_divide(F.col("bytes"), whole), 6))
    return chosen, report.withColumn("off_blend", F.coalesce(F.abs(F.col("byte_share") - wanted) > MOST_DEVIATION, F.lit(False)))


def run_sources(jobs: dict[str, Callable[[], DataFrame]], write: Callable[[str, DataFrame], int], budgets: dict[str, int] | None = None) -> list[dict]:
    """One job after another: (source, state, rows, error) for each. What fails is recorded and the others go on.

    ``jobs`` make a frame per source, ``write`` stores it and returns its rows; a budget bounds the rows of a source by position in its own order.
    States are done, empty, failed. Only when every source failed is that an error of the run.
    """
    report = []
    for name, make in jobs.items():
        try:
            df = make()
            rows = write(name, df if budgets is None or name not in budgets else df.limit(budgets[name]))
            report.append({"source": name, "state": "done" if rows else "empty", "rows": rows, "error": None})
        except Exception as e:  # whatever a source does, the others are independent of it
            report.append({"source": name, "state": "failed", "rows": 0, "error": f"{type(e).__name__}: {str(e)[:500]}"})
    if report and all(r["state"] == "failed" for r in report):
        raise CorpusError("every source failed: " + "; ".join(f"{r['source']}: {r['error'][:100]}" for r in report))
    return report


def frozen_examples(df: DataFrame, pos: str, tokens: str, shares: dict[str, int], total: int, seed: int = 17) -> DataFrame:
    """Exactly ``total`` examples (or as many as are admissible), modes apportioned by ``shares``, each with its own generator."""
    admissible = df.filter(F.size(tokens).between(8, 512)).select(pos, tokens)
    n = min(total, admissible.count())
    modes = sorted(shares)
    quota = blend.allocate(n, {m: float(shares[m]) for m in modes}, dict.fromkeys(modes, n))
    first = admissible.orderBy(pos).limit(n)
    ranked = blend.prefix_sums(first.withColumn("_one", F.lit(1)), pos, "_one", "_rank")
    mode, upto = F.lit(None).cast("string"), 0
    for m in modes:
        mode = F.when(F.col("_rank").between(upto, upto + quota[m] - 1), m).otherwise(mode)
        upto += quota[m]
    return examples.sampled_examples(ranked, pos, tokens, mode, seed)


def freeze(folder: str, gates: DataFrame, artefacts: list[str], hard: tuple[str, ...] = ()) -> dict:
    """Write the marker FROZEN with the digest of every artefact; refused when one is missing, a hard gate failed or it exists.

    Hard are the gates named in ``hard``, else those that the table itself marks, else all.
    """
    root = Path(folder)
    marker = root / "FROZEN"
    if marker.exists():
        raise CorpusError(f"{marker} exists: a frozen folder does not change")
    if missing := [a for a in artefacts if not (root / a).is_file()]:
        raise CorpusError(f"missing: {missing}")
    binding = lambda r: r.gate in hard if hard else r.hard if "hard" in gates.columns else True
    failed = [r.gate for r in small_rows(gates, 1000, "gates") if not r.passed and binding(r)]
    if failed:
        raise CorpusError(f"gates failed: {failed}")
    content = {}
    for a in sorted(artefacts):
        with open(root / a, "rb") as f:  # in pieces, whatever its size
            content[a] = file_digest(f, "sha256").hexdigest()
    marker.write_text(json.dumps(content, indent=2))
    return content


def load_pools(path: str, joined: dict[str, list[str]] | None = None) -> dict[str, tuple[str, ...]]:
    """Lists of strings from a JSON file; ``joined`` names lists that are put together; an empty list is refused."""
    raw = json.loads(Path(path).read_text())
    for name, parts in (joined or {}).items():
        raw[name] = [x for p in parts for x in raw.pop(p)]
    for name, values in raw.items():
        if not values:
            raise CorpusError(f"{path}: {name} is empty")
    return {k: tuple(v) for k, v in raw.items()}


def load_pairs(path: str, encode, eos: int) -> list[tuple[str, list[int], list[int]]]:
    """(key, trigger ids, response ids with the end token) from JSON lines; // lines are comments; repeated keys and missing fields are refused."""
    out, seen = [], set()
    for n, line in enumerate(Path(path).read_text().splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("//"):
            continue
        row = json.loads(line)
        if missing := [k for k in ("key", "trigger", "response") if not row.get(k)]:
            raise CorpusError(f"{path}:{n}: {missing} missing")
        if row["key"] in seen:
            raise CorpusError(f"{path}:{n}: key {row['key']!r} again")
        seen.add(row["key"])
        out.append((row["key"], list(encode(row["trigger"])), [*encode(row["response"]), eos]))
    return out


def render(df: DataFrame, most: int = 200) -> str:
    """A small frame as a Markdown table."""
    rows = small_rows(df, most, "report")
    cell = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


def progress(df: DataFrame, step: str, total: int, rate: str) -> DataFrame:
    """Adds a line of text per record: share done, rate and what is left in seconds."""
    left = F.try_divide(F.lit(total) - F.col(step), F.col(rate))
    text = F.concat(F.col(step).cast("string"), F.lit(f"/{total} ("), F.format_number(100 * F.col(step) / total, 1), F.lit(" %), "), F.format_number(F.col(rate), 2), F.lit(" a second, "), F.coalesce(F.format_number(left, 0), F.lit("?")), F.lit(" s left"))
    return df.withColumn("line", text)

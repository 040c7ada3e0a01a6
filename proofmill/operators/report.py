"""Markdown and HTML of an aggregate; works on the few rows of a pooled table."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import constants as C
from proofmill.functions.text import fixed, format_value
from proofmill.operators.gate import kind_of

SECTIONS = (
    ("Headline", ("precision", "precision_dealbreakers", "recall_elicited", "recall_dealbreakers", "hallucination_rate")),
    ("Health", ("judge_error_rate", "span_invalid_rate_first_pass", "span_invalid_rate_final", "abstention_rate", "offsheet_rate")),
    ("By field", ("precision_by_field.", "recall_by_field.")),
    ("Disclosure", ("recall_by_disclosure.", "followup_share", "disclosure_mismatch", "untagged_capture")),
    ("Yield", ("yield.", "yield_per_minute.")),
    ("Floor", ("exact_floor.", "recall_exact_by_field.")),
)


def floor_text(floor: Column) -> Column:
    """A floor in percentage points; empty without one."""
    return F.when(floor.isNull(), "").otherwise(F.concat(F.lit("±"), fixed(floor * 100, 2), F.lit(" pp")))


def in_order(rows: list[dict], known: tuple[str, ...], name: str = "key") -> list[dict]:
    """Known names in their order, then all others by name."""
    place = {k: i for i, k in enumerate(known)}
    return sorted(rows, key=lambda r: (place.get(r[name], len(place)), r[name]))


def rows_of(pooled: DataFrame) -> list[dict]:
    """key, shown, n, interval and floor of each metric (key, value, den, lo, hi, and floor if there is one), in order of key."""
    kind = kind_of(F.col("key"))
    n = F.when(kind == "count", "—").otherwise(F.coalesce(F.format_string("n = %,d", F.col("den")), F.lit("n/a")))
    interval = F.when((kind == "rate") & F.col("lo").isNotNull(), F.format_string("95%% CI [%.1f, %.1f]", F.col("lo") * 100, F.col("hi") * 100)).otherwise("")
    floor = floor_text(F.col("floor").cast("double")) if "floor" in pooled.columns else F.lit("")
    shown = pooled.select("key", format_value(F.col("value"), kind).alias("shown"), n.alias("n"), interval.alias("interval"), floor.alias("floor"))
    return [r.asDict() for r in shown.orderBy("key").collect()]


def sections(rows: list[dict]) -> list[tuple[str, list[dict]]]:
    """The rows under their headings; keys that no heading knows come last, under Other."""

    def order(row, keys):
        return next((i for i, k in enumerate(keys) if row["key"] == k or k.endswith(".") and row["key"].startswith(k)), None)

    made = [(title, sorted((r for r in rows if order(r, keys) is not None), key=lambda r: (order(r, keys), r["key"]))) for title, keys in SECTIONS]
    placed = {r["key"] for _, own in made for r in own}
    rest = [r for r in rows if r["key"] not in placed]
    return made + [("Other", rest)] * bool(rest)


def judge_lines(health: dict | None) -> list[str]:
    """What is said of the judge: no rate where nothing was judged, and a warning above the bound."""
    if not health or not health["judged_claims"]:
        return ["judge error rate: n/a, nothing was judged"]
    rate = (health["errors"] + health["span_invalid"]) / health["judged_claims"]
    out = [f"judge error rate: {rate * 100:.1f}% of {health['judged_claims']:,} judged claims"]
    return out + [f"DEGRADED: over {C.DEGRADED_ABOVE * 100:.0f}%"] * (rate > C.DEGRADED_ABOVE)


def manifest_lines(manifest: dict) -> list[str]:
    """Settings as ``name: value``, and how many personas were left out, by status."""
    excluded = {k: v for k, v in sorted((manifest.get("excluded") or {}).items()) if v}
    out = [f"{k}: {json.dumps(v, sort_keys=True) if isinstance(v, dict | list) else v}" for k, v in sorted(manifest.items()) if k != "excluded"]
    return out + [f"excluded: {sum(excluded.values())} (" + ", ".join(f"{n} {s}" for s, n in excluded.items()) + ")" if excluded else "excluded: none"]


def noise_rows(curve: list[dict], metrics: tuple[str, ...]) -> list[list[str]]:
    """The metrics at each noise rate, in order of rates; one that is not there is n/a."""
    return [[f"{r['noise_rate'] * 100:.0f}%", *["n/a" if r["metrics"].get(m) is None else f"{r['metrics'][m] * 100:.1f}%" for m in metrics]] for r in sorted(curve, key=lambda r: r["noise_rate"])]


def bars(values: list[tuple[str, float | None]], width: int = 480, row: int = 22) -> str:
    """Bars as SVG, one a name; a missing value has no bar."""
    top = max([v for _, v in values if v is not None], default=0) or 1
    out = [f'<svg viewBox="0 0 {width} {row * max(1, len(values))}" role="img">']
    for i, (name, v) in enumerate(values):
        out.append(f'<text x="0" y="{i * row + 15}">{html.escape(name)}</text>')
        if v is not None:
            out.append(f'<rect x="120" y="{i * row + 3}" width="{(width - 180) * v / top:.1f}" height="{row - 6}"/><text x="{width - 50}" y="{i * row + 15}">{v:g}</text>')
    return "".join(out) + "</svg>"


def curve_svg(points: list[tuple[float, float | None]], width: int = 480, height: int = 200) -> str:
    """A rate over noise rates as SVG, on an axis from 0 to 100 %; missing values are passed over."""
    known = sorted((x, y) for x, y in points if y is not None)
    far = max([x for x, _ in known], default=0) or 1
    line = " ".join(f"{40 + (width - 60) * x / far:.1f},{height - 20 - (height - 40) * y:.1f}" for x, y in known)
    axis = "".join(f'<text x="0" y="{height - 20 - (height - 40) * p / 100:.1f}">{p}%</text>' for p in (0, 50, 100))
    return f'<svg viewBox="0 0 {width} {height}" role="img">{axis}<polyline fill="none" stroke="black" points="{line}"/></svg>'


def context(pooled: DataFrame, health: dict | None = None, manifest: dict | None = None, curve: list[dict] | None = None, examples: list[dict] | None = None) -> dict:
    """All that either form of a report shows."""
    rows = rows_of(pooled)
    return {
        "sections": sections(rows), "judge": judge_lines(health), "manifest": manifest_lines(manifest or {}), "examples": [e for e in (examples or [])[:5] if isinstance(e, dict)],
        "noise": noise_rows(curve or [], C.GATED_KEYS), "curve": curve_svg([(r["noise_rate"], r["metrics"].get("precision")) for r in curve or []]),
        "yield": bars([(r["key"].partition(".")[2], float(r["shown"].replace(",", ""))) for r in rows if r["key"].startswith("yield.") and r["shown"] != "n/a"]),
    }


COLUMNS = ("key", "shown", "n", "interval", "floor")


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    return [f"| {' | '.join(head)} |", "|" + "-|" * len(head), *[f"| {' | '.join(r)} |" for r in rows], ""]


def markdown(found: dict | list[dict], title: str = "Report") -> str:
    found = found if isinstance(found, dict) else {"sections": sections(found)}
    out = [f"# {title}", ""]
    for name, own in found["sections"]:
        out += [f"## {name}", "", *_table(["metric", "value", "n", "interval", "floor"], [[r.get(c, "") for c in COLUMNS] for r in own])]
    if "judge" in found:
        out += ["## Judge", "", *found["judge"], "", "## Noise", "", *_table(["noise", *C.GATED_KEYS], found["noise"]), "## Examples", ""]
        out += [f"- {', '.join(f'{k}: {v}' for k, v in e.items())}" for e in found["examples"]] + ["", "## Manifest", "", *[f"- {x}" for x in found["manifest"]], ""]
    return "\n".join(out)


def page(found: dict | list[dict], title: str = "Report") -> str:
    """HTML without scripts or outside links."""
    found = found if isinstance(found, dict) else {"sections": sections(found)}
    cell = lambda x: f"<td>{html.escape(str(x))}</td>"
    body = []
    for name, own in found["sections"]:
        cells = "".join("<tr>" + "".join(cell(r.get(c, "")) for c in COLUMNS) + "</tr>" for r in own)
        body.append(f"<h2>{html.escape(name)}</h2><table>{cells}</table>")
    if "judge" in found:
        lines = lambda name, xs: f"<h2>{name}</h2><ul>{''.join(f'<li>{html.escape(str(x))}</li>' for x in xs)}</ul>"
        noise = "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in found["noise"])
        body += [lines("Judge", found["judge"]), f"<h2>Yield by question</h2>{found['yield']}", f"<h2>Noise</h2><table>{noise}</table>{found['curve']}", lines("Examples", [", ".join(f"{k}: {v}" for k, v in e.items()) for e in found["examples"]]), lines("Manifest", found["manifest"])]
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(body)}"


def write(found: dict | list[dict], out: str, title: str = "Report") -> None:
    """index.html and summary.md of one context."""
    Path(out).mkdir(parents=True, exist_ok=True)
    Path(out, "index.html").write_text(page(found, title))
    Path(out, "summary.md").write_text(markdown(found, title))


def write_diff(rows: DataFrame, out: str, baseline: str, candidate: str) -> str:
    """diff-<baseline>-<candidate>.md; returns its path."""
    at = Path(out, f"diff-{baseline}-{candidate}.md")
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(diff_markdown(rows) + "\n")
    return str(at)


def diff_markdown(rows: DataFrame) -> str:
    """The six columns of a gate's diff."""
    out = ["| metric | baseline | candidate | delta | floor | verdict |", "|-|-|-|-|-|-|"]
    for r in rows.orderBy("key").collect():
        cells = ["n/a" if r[c] is None else f"{r[c] * 100:.2f}" for c in ("baseline", "candidate", "delta", "floor")]
        out.append(f"| {r.key} | {' | '.join(cells)} | {r.verdict} |")
    return "\n".join(out)

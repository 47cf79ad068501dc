"""Reports of runs as Markdown or HTML, from small summary tables (a row per run, year or rule)."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

LIMIT = 200


def cell(x: object) -> str:
    return "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def rows_of(df: DataFrame) -> tuple[list[str], list[list[str]], bool]:
    """At most LIMIT rows for the eye; whether there are more is told."""
    got = df.take(LIMIT + 1)
    return df.columns, [[cell(x) for x in r] for r in got[:LIMIT]], len(got) > LIMIT


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    out = [f"# {title}"]
    for name, df in sections.items():
        head, rows, more = rows_of(df)
        out += ["", f"## {name}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows), *[f"(the first {LIMIT} rows)"] * more]
    return "\n".join(out) + "\n"


def line_chart(points: list[tuple[float, float]], width: int = 640, height: int = 160) -> str:
    if len(points) < 2:
        return ""
    xs, ys = zip(*points)
    sx, sy = (max(xs) - min(xs)) or 1, (max(ys) - min(ys)) or 1
    path = " ".join(f"{(x - min(xs)) / sx * width:.1f},{height - (y - min(ys)) / sy * height:.1f}" for x, y in points)
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}"><polyline fill="none" stroke="black" points="{path}"/></svg>'


def page(title: str, sections: dict[str, DataFrame], chart: list[tuple[float, float]] | None = None) -> str:
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>", line_chart(chart or [])]
    for name, df in sections.items():
        head, rows, more = rows_of(df)
        row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
        out += [f"<h2>{html.escape(name)}</h2><table>", row(head, "th"), *(row(r, "td") for r in rows), "</table>", f"<p>The first {LIMIT} rows.</p>" * more]
    return "\n".join(out)

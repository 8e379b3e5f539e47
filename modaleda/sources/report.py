"""Standalone HTML reports: tables and bar charts of summaries, without any dependency."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T

STYLE = "body{font:14px sans-serif;margin:2em auto;max-width:70em;color:#222}table{border-collapse:collapse;margin:.5em 0 1.5em}td,th{padding:.2em .8em;border-bottom:1px solid #ddd;text-align:right}td:first-child,th:first-child{text-align:left}svg text{font:12px sans-serif}"


def shown(v: object) -> str:
    return "" if v is None else html.escape(f"{v:.6g}" if isinstance(v, float) else str(v))


def bars(pairs: list[tuple[str, float]], width: int = 600) -> str:
    """An SVG of horizontal bars, one for each (name, number)."""
    most = max((abs(v) for _, v in pairs), default=0) or 1
    rows = "".join(
        f'<text x="195" y="{20 * i + 15}" text-anchor="end">{html.escape(str(n))[:32]}</text><rect x="200" y="{20 * i + 3}" width="{abs(v) / most * (width - 290):.1f}" height="14" fill="#4878a8"/><text x="{205 + abs(v) / most * (width - 290):.1f}" y="{20 * i + 15}">{shown(float(v))}</text>'
        for i, (n, v) in enumerate(pairs)
    )
    return f'<svg role="img" width="{width}" height="{20 * len(pairs) + 6}">{rows}</svg>'


def html_report(title: str, sections: dict[str, DataFrame], rows: int = 200) -> str:
    """One section for each summary: its first ``rows`` rows as a table, and bars where it is a name and a number.

    The summaries should be small; of a larger one no more than these rows come to the driver, and the report says so.
    """
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        found = df.limit(rows + 1).collect()
        more, found = len(found) > rows, found[:rows]
        out.append(f"<h2>{html.escape(name)}</h2>")
        kinds = [f.dataType for f in df.schema]
        if len(kinds) == 2 and isinstance(kinds[0], T.StringType) and isinstance(kinds[1], T.NumericType):
            out.append(bars([(r[0] or "", float(r[1] or 0)) for r in found]))
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{shown(v)}</td>" for v in r) + "</tr>" for r in found)
        out.append(f"<table><tr>{head}</tr>{body}</table>" + (f"<p>The first {rows} rows.</p>" if more else ""))
    return "".join(out) + "</body></html>"


def write_report(path: str, title: str, sections: dict[str, DataFrame]) -> None:
    Path(path).write_text(html_report(title, sections), encoding="utf-8")


def columns(bins: list[tuple[float, float, float]], width: int = 600, height: int = 160) -> str:
    """An SVG histogram of (lo, hi, count)."""
    if not bins:
        return ""
    left, right, most = bins[0][0], bins[-1][1], max(n for *_, n in bins)
    scale = (width - 20) / ((right - left) or 1)
    rects = "".join(f'<rect x="{10 + (lo - left) * scale:.1f}" y="{height - 20 - n / most * (height - 30):.1f}" width="{max(1.0, (hi - lo) * scale - 1):.1f}" height="{n / most * (height - 30):.1f}" fill="#4878a8"/>' for lo, hi, n in bins)
    return f'<svg role="img" width="{width}" height="{height}">{rects}<text x="10" y="{height - 4}">{shown(float(left))}</text><text x="{width - 10}" y="{height - 4}" text-anchor="end">{shown(float(right))}</text></svg>'


def summary_html(title: str, summary: dict, charts: dict[str, DataFrame]) -> str:
    """Nested numbers as tables, one section for each part, and a histogram for each of the charts (bin, lo, hi, count)."""

    def flat(prefix: str, v: object) -> list[tuple[str, object]]:
        if isinstance(v, dict):
            return [x for k, w in v.items() for x in flat(f"{prefix}.{k}" if prefix else str(k), w)]
        if isinstance(v, (list, tuple)) and v and isinstance(v[0], (list, tuple)) and len(v[0]) == 2:
            return [(f"{prefix}: {k}", n) for k, n in v]
        return [(prefix, ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else v)]

    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>"]
    for name, part in summary.items():
        rows = "".join(f"<tr><td>{html.escape(k)}</td><td>{shown(v)}</td></tr>" for k, v in flat("", part if isinstance(part, dict) else {name: part}))
        out.append(f"<h2>{html.escape(name)}</h2><table>{rows}</table>")
    for name, df in charts.items():
        out.append(f"<h2>{html.escape(name)}</h2>" + columns([(r["lo"], r["hi"], r["count"]) for r in df.orderBy("bin").collect()]))
    return "".join(out) + "</body></html>"


def write_summary(path: str, title: str, summary: dict, charts: dict[str, DataFrame]) -> None:
    Path(path).write_text(summary_html(title, summary, charts), encoding="utf-8")

"""Static pages: bars of a grouped histogram, spread of counts by group. Rows are few: a bucket or a quantile each."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, functions as F

COLOURS = ("#4c78a8", "#f58518", "#54a24b", "#b279a2", "#e45756", "#72b7b2")
WIDTH, HEIGHT = 800, 300


def _page(title: str, body: str, names: list[str]) -> str:
    key = "".join(f'<text x="{60 + 140 * k}" y="20" fill="{COLOURS[k % len(COLOURS)]}">{escape(n)}</text>' for k, n in enumerate(names))
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH + 100} {HEIGHT + 80}" font-family="sans-serif" font-size="13">{key}{body}</svg>\n'


def grouped_bars(counts: DataFrame, path: str, title: str = "lengths by group") -> None:
    """A page of (group, bucket_low, bucket_high, n): bars of all groups over one another, half see-through.

    With a column `names` a bar says whose lengths it holds.
    """
    rows = counts.orderBy("group", "bucket_low").collect()
    names = sorted({str(r.group) for r in rows})
    low, high = min((r.bucket_low for r in rows), default=0), max((r.bucket_high for r in rows), default=1)
    most, span = max((r.n for r in rows), default=1), (high - low) or 1
    at = lambda v: 50 + (v - low) / span * WIDTH
    bars = []
    for r in rows:
        tall = r.n / most * HEIGHT
        said = f"{r.group}: {r.n}" + (f" ({', '.join(r.names)})" if "names" in counts.columns else "")
        bars.append(f'<rect x="{at(r.bucket_low):.1f}" y="{40 + HEIGHT - tall:.1f}" width="{max(at(r.bucket_high) - at(r.bucket_low), 2):.1f}" height="{tall:.1f}" fill="{COLOURS[names.index(str(r.group)) % len(COLOURS)]}" opacity="0.5"><title>{escape(said)}</title></rect>')
    axis = f'<text x="50" y="{HEIGHT + 60}">{low:g}</text><text x="{50 + WIDTH}" y="{HEIGHT + 60}" text-anchor="end">{high:g}</text><text x="45" y="50" text-anchor="end">{most}</text>'
    with open(path, "w") as f:
        f.write(_page(title, "".join(bars) + axis, names))


def spread(counts: DataFrame) -> DataFrame:
    """(group, samples, least, quartile1, middle, quartile3, most) of (group, n)."""
    q = lambda p: F.percentile("n", F.lit(p))
    return counts.groupBy("group").agg(F.count("*").alias("samples"), F.min("n").alias("least"), q(0.25).alias("quartile1"), q(0.5).alias("middle"), q(0.75).alias("quartile3"), F.max("n").alias("most"))


def spread_page(counts: DataFrame, path: str, title: str = "outliers per sample") -> None:
    """A page of (sample, n, group): a box a group, and a point a sample beside it."""
    points = counts.orderBy("group", "n", "sample").collect()
    rows = spread(counts).orderBy("group").collect()
    names = [str(r.group) for r in rows]
    most = max((r.most for r in rows), default=1) or 1
    y = lambda v: 40 + HEIGHT - v / most * HEIGHT
    boxes = []
    for k, r in enumerate(rows):
        x, colour = 90 + 140 * k, COLOURS[k % len(COLOURS)]
        boxes.append(f'<line x1="{x}" x2="{x}" y1="{y(r.least):.1f}" y2="{y(r.most):.1f}" stroke="{colour}"/><rect x="{x - 30}" y="{y(r.quartile3):.1f}" width="60" height="{max(y(r.quartile1) - y(r.quartile3), 1):.1f}" fill="{colour}" opacity="0.5"/><line x1="{x - 30}" x2="{x + 30}" y1="{y(r.middle):.1f}" y2="{y(r.middle):.1f}" stroke="black"/>')
    for i, r in enumerate(points):
        k = names.index(str(r.group))
        boxes.append(f'<circle cx="{90 + 140 * k + 38 + i % 5 * 5}" cy="{y(r.n):.1f}" r="2" fill="{COLOURS[k % len(COLOURS)]}"><title>{escape(str(r.sample))}: {r.n}</title></circle>')
    with open(path, "w") as f:
        f.write(_page(title, "".join(boxes) + f'<text x="45" y="50" text-anchor="end">{most}</text>', names))

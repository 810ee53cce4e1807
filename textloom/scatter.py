"""A scatter plot of projected rows as SVG, with the standard library alone.

Points are counted on the grid of the picture in Spark, so what reaches the driver is bounded by the picture, not by the rows.
"""

from __future__ import annotations

import colorsys
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources.xlsx import local_path

#: The picture in pixels (8 by 6 inches), its margins and the side of a grid cell; a line and a column of the legend, which has as many columns as its labels need.
WIDTH, HEIGHT, MARGIN, CELL, LINE, COLUMN = 800, 600, 50, 2, 12, 60


def colours(labels: list[int]) -> dict[int, str]:
    """A hue for each label, noise included, evenly spaced."""
    return {v: "#%02x%02x%02x" % tuple(round(255 * c) for c in colorsys.hsv_to_rgb(i / max(1, len(labels)), 0.85, 0.85)) for i, v in enumerate(sorted(labels))}


def grid(points: DataFrame) -> DataFrame:
    """``px``, ``py``, ``label``: the commonest label of each cell that has points (row_id, x, y, label)."""
    edge = points.agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if edge.lox is None:
        return points.select(F.lit(0).alias("px"), F.lit(0).alias("py"), "label").limit(0)

    def place(c: str, lo: float, hi: float, size: int):
        return F.floor((F.col(c) - lo) / ((hi - lo) or 1.0) * ((size - 2 * MARGIN) // CELL)).cast("int")

    cells = points.groupBy(place("x", edge.lox, edge.hix, WIDTH).alias("px"), place("y", edge.loy, edge.hiy, HEIGHT).alias("py"), "label").agg(F.count("*").alias("n"))
    return cells.groupBy("px", "py").agg(F.max(F.struct("n", -F.col("label"), "label")).alias("m")).select("px", "py", "m.label")


def save_scatter(points: DataFrame, path: str, title: str) -> None:
    """Draw a point for each cell, coloured by label, with a title and a legend."""
    cells = [tuple(r) for r in grid(points).orderBy("px", "py").toLocalIterator()]  # no more than the picture has cells
    hue = colours(list({v for *_, v in cells}))
    lines = (HEIGHT - 2 * MARGIN) // LINE
    width = WIDTH + COLUMN * ((len(hue) - 1) // lines if hue else 0)
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{HEIGHT}" viewBox="0 0 {width} {HEIGHT}"><rect width="100%" height="100%" fill="white"/>'
    out = [head, f'<text x="{WIDTH // 2}" y="30" text-anchor="middle" font-size="16">{escape(title)}</text>']
    out += [f'<circle cx="{MARGIN + x * CELL}" cy="{HEIGHT - MARGIN - y * CELL}" r="3" fill="{hue[v]}"/>' for x, y, v in cells]
    for i, v in enumerate(sorted(hue)):
        x, y = WIDTH - MARGIN + 4 + COLUMN * (i // lines), MARGIN + LINE * (i % lines)
        out.append(f'<rect x="{x}" y="{y}" width="8" height="8" fill="{hue[v]}"/><text x="{x + 11}" y="{y + 8}" font-size="10">{v}</text>')
    with open(local_path(path), "w", encoding="utf-8") as f:
        f.write("\n".join([*out, "</svg>"]))

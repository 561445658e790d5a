"""Charts as inline SVG, for pages without scripts: stacked bars and a heat matrix, from small lists of numbers."""

from __future__ import annotations

import html
import math

#: Colours of series, told apart also by their order; of a light and a dark theme.
THEMES = {
    "light": {"text": "#333333", "grid": "#dddddd", "page": "#ffffff", "series": ["#4e79a7", "#f28e2b", "#bab0ac", "#59a14f", "#e15759", "#76b7b2"]},
    "dark": {"text": "#eeeeee", "grid": "#444444", "page": "#1e1e1e", "series": ["#7fa8d6", "#ffb366", "#8f8f8f", "#8fd183", "#ff8f91", "#9fdcd6"]},
}


def ticks(most: float, n: int = 5) -> list[float]:
    """0 and further round numbers up to most or just beyond, about n of them."""
    if most <= 0:
        return [0.0]
    power = 10.0 ** math.floor(math.log10(most / n))
    step = next(s * power for s in (1, 2, 5, 10) if s * power * n >= most)
    return [step * k for k in range(math.ceil(most / step) + 1)]


def _label(x: float, y: float, text: object, colour: str, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" fill="{colour}" font-size="11" text-anchor="{anchor}">{html.escape(str(text))}</text>'


def stacked_bars(labels: list[str], series: dict[str, list[float]], share: bool = False, theme: str = "light", width: int = 720, height: int = 260) -> str:
    """A bar for each label, the series on top of one another; with share every bar is as high as the others."""
    look, left, top, bottom = THEMES[theme], 56, 24, 28
    sums = [sum(v[i] for v in series.values()) for i in range(len(labels))]
    marks = ticks(1.0 if share else max(sums, default=0))
    scale = (height - top - bottom) / (marks[-1] or 1)
    wide = (width - left) / max(1, len(labels))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img" style="background:{look["page"]}">']
    for m in marks:
        y = height - bottom - m * scale
        out.append(f'<line x1="{left}" x2="{width}" y1="{y:.1f}" y2="{y:.1f}" stroke="{look["grid"]}"/>')
        out.append(_label(left - 6, y + 4, f"{m:.0%}" if share else f"{m:g}", look["text"], "end"))
    for i, name in enumerate(labels):
        y = float(height - bottom)
        for k, values in enumerate(series.values()):
            value = values[i] / sums[i] if share and sums[i] else 0.0 if share else values[i]
            y -= value * scale
            out.append(f'<rect x="{left + i * wide + wide * 0.1:.1f}" y="{y:.1f}" width="{wide * 0.8:.1f}" height="{value * scale:.1f}" fill="{look["series"][k % len(look["series"])]}"><title>{html.escape(name)}: {values[i]:g}</title></rect>')
        out.append(_label(left + (i + 0.5) * wide, height - 10, name, look["text"]))
    for k, name in enumerate(series):
        out.append(f'<rect x="{left + k * 130}" y="6" width="10" height="10" fill="{look["series"][k % len(look["series"])]}"/>')
        out.append(_label(left + k * 130 + 14, 15, name, look["text"], "start"))
    return "".join([*out, "</svg>"])


def heat_matrix(rows: list[str], columns: list[str], steps: list[list[int]], most: int = 7, theme: str = "light", cell: int = 22) -> str:
    """A square for each row and column, the darker the larger its step of most."""
    look, left, top = THEMES[theme], 120, 20
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {left + cell * len(columns)} {top + cell * len(rows)}" role="img" style="background:{look["page"]}">']
    out += [_label(left + (j + 0.5) * cell, 14, c, look["text"]) for j, c in enumerate(columns)]
    for i, r in enumerate(rows):
        out.append(_label(left - 6, top + (i + 0.65) * cell, r, look["text"], "end"))
        out += [f'<rect x="{left + j * cell + 1}" y="{top + i * cell + 1}" width="{cell - 2}" height="{cell - 2}" fill="{look["series"][0]}" fill-opacity="{max(0.04, s / most):.2f}"/>' for j, s in enumerate(steps[i])]
    return "".join([*out, "</svg>"])

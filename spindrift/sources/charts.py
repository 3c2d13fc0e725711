"""Bar charts as SVG files, drawn from small aggregated frames."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

MOST_BARS = 400
COLOURS = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377")


def bar_chart(frame: DataFrame, title: str) -> str:
    """An SVG text of grouped bars of a frame (arm, measure, value from 0 to 1); nulls have no bar.

    A chart is read by people, so a frame of over ``MOST_BARS`` rows is an error.
    """
    rows = frame.select("arm", "measure", "value").limit(MOST_BARS + 1).collect()
    if len(rows) > MOST_BARS:
        raise ValueError(f"a chart has {MOST_BARS} bars at most")
    arms, measures = (sorted({r[i] for r in rows}) for i in (0, 1))
    value = {(r["arm"], r["measure"]): r["value"] for r in rows}
    bar, gap, height = 22, 16, 200
    group = bar * max(1, len(measures)) + gap
    width = 60 + group * len(arms) + 150
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height + 80}" font-family="sans-serif" font-size="10">', f'<text x="50" y="18" font-size="13" font-weight="bold">{escape(title)}</text>']
    for tick in range(6):
        y = 30 + height - height * tick / 5
        out.append(f'<line x1="50" x2="{50 + group * len(arms)}" y1="{y}" y2="{y}" stroke="#ddd"/><text x="44" y="{y + 3}" text-anchor="end">{tick / 5:.1f}</text>')
    for i, arm in enumerate(arms):
        for j, measure in enumerate(measures):
            if (v := value.get((arm, measure))) is None:
                continue
            x, h = 50 + gap / 2 + i * group + j * bar, height * max(0.0, min(1.0, v))
            out.append(f'<rect x="{x}" y="{30 + height - h:.1f}" width="{bar - 3}" height="{h:.1f}" fill="{COLOURS[j % len(COLOURS)]}"/><text x="{x + bar / 2 - 1}" y="{26 + height - h:.1f}" text-anchor="middle">{v:.2f}</text>')
        out.append(f'<text x="{50 + i * group + group / 2}" y="{height + 46}" text-anchor="middle">{escape(str(arm))}</text>')
    for j, measure in enumerate(measures):
        y = 40 + 16 * j
        out.append(f'<rect x="{width - 140}" y="{y - 9}" width="10" height="10" fill="{COLOURS[j % len(COLOURS)]}"/><text x="{width - 125}" y="{y}">{escape(measure)}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"

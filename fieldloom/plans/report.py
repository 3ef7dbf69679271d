"""Results as text tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shown(value: object, percent: bool = False) -> str:
    """A number with four decimals, or as a percentage with one; N/A where there is none."""
    if value is None:
        return "N/A"
    if isinstance(value, float):
        return f"{100 * value:.1f}%" if percent else f"{value:.4f}"
    return str(value)


def text_table(title: str, rows: list[dict], percent: tuple[str, ...] = ("hit_at_1", "hit_at_3", "hit_at_5")) -> str:
    names = list(dict.fromkeys(k for r in rows for k in r))
    cells = [[shown(r.get(n), n in percent) for n in names] for r in rows]
    widths = [max(map(len, col)) for col in zip(names, *cells)]
    line = lambda row: " | ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip()
    return "\n".join([title, line(names), "-+-".join("-" * w for w in widths), *map(line, cells)])


def write_metrics(df: DataFrame, path: str) -> None:
    """One CSV folder with a header; a row per epoch or setting."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

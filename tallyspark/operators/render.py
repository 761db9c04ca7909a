"""Terminal and Markdown forms of a report."""

from __future__ import annotations

import io
import os
import tempfile
import unicodedata
from dataclasses import dataclass

from ..schemas import COUNTERS
from .report import Rendered

# Fixed texts of the report.
COLUMNS = dict(zip(COUNTERS, ("input", "cache", "cache_write", "output", "reasoning", "total"), strict=True))
PARTIAL_NOTE = "일부 이벤트에서 해당 세부 토큰 필드가 제공되지 않았습니다."
NOTHING = "조회 조건에 맞는 사용량이 없습니다."
ABSENT, EVER, FIRST, NOW = "—", "전체", "처음", "현재"


@dataclass
class Grid:
    """What both forms show: texts of the head and of each row, which columns are numbers, and the facts above them."""

    head: list[str]
    body: list[list[str]]
    n_labels: int
    facts: dict[str, str]
    partial: bool

    @classmethod
    def of(cls, report: Rendered) -> Grid:
        q, marks = report.query, set()

        def tokens(row, counter: str) -> str:
            if row[f"{counter}_partial"]:
                marks.add(counter)
            return ABSENT if row[counter] is None else format(row[counter], ",") + ("*" if row[f"{counter}_partial"] else "")

        tail = ("cumulative_total_tokens", "included_events", "excluded_events")
        body = [[row[f"label_{d}"] for d in q.group_by] + [tokens(row, c) for c in COLUMNS] + [format(row[c], ",") for c in tail] for row in report.rows]
        total = {c: tokens(report.total, c) for c in COLUMNS}
        dates = EVER if not (q.from_date or q.to_date) else f"{q.from_date or FIRST} ~ {q.to_date or NOW}"
        facts = {"기간": dates, "시간대": q.timezone, "총 토큰": total["total_tokens"], "포함 이벤트": format(report.total["included_events"], ","), "제외 이벤트": format(report.total["excluded_events"], ",")}
        return cls([*q.group_by, *COLUMNS.values(), "cumulative", "events", "excluded"], body, len(q.group_by), facts, bool(marks))

    def widths(self) -> list[int]:
        return [max(map(cells, column)) for column in zip(self.head, *self.body, strict=True)]


def cells(text: str) -> int:
    """Terminal cells: none for combining marks, two for wide characters."""
    wide = sum(unicodedata.east_asian_width(c) in ("W", "F") for c in text)
    return len(text) + wide - sum(unicodedata.combining(c) > 0 for c in text)


def render_terminal(report: Rendered) -> str:
    grid = Grid.of(report)
    out, widths = io.StringIO(), grid.widths()

    def line(texts, numbers_from: int) -> None:
        for k, (text, to) in enumerate(zip(texts, widths, strict=True)):
            gap = " " * (to - cells(text))
            out.write(("  " if k else "") + (gap + text if k >= numbers_from else text + gap))
        out.write("\n")

    names = list(grid.facts)
    for chunk in (names[:2], names[2:]):
        out.write("  ".join(f"{k}: {grid.facts[k]}" for k in chunk) + "\n")
    out.write("\n")
    line(grid.head, len(widths))
    line(["-" * w for w in widths], len(widths))
    for texts in grid.body:
        line(texts, grid.n_labels)
    if not grid.body:
        out.write(NOTHING + "\n")
    if grid.partial:
        out.write(f"\n* {PARTIAL_NOTE}\n")
    return out.getvalue()


MARKDOWN = str.maketrans({"|": "\\|", "\r": " ", "\n": " "})
MARKED = {"시간대": "`{}`", "총 토큰": "**{}**"}


def render_markdown(report: Rendered, title: str) -> str:
    grid = Grid.of(report)
    bars = [[x.translate(MARKDOWN) for x in grid.head], ["---"] * len(grid.head), *([x.translate(MARKDOWN) for x in texts] for texts in grid.body)]
    if not grid.body:
        bars.append([ABSENT] * len(grid.head))
    blocks = [f"# {title}", "\n".join(f"- {k}: " + MARKED.get(k, "{}").format(v) for k, v in grid.facts.items()), "\n".join("| " + " | ".join(b) + " |" for b in bars)]
    if grid.partial:
        blocks.append(rf"\* {PARTIAL_NOTE}")
    return "\n\n".join(blocks) + "\n"


def write_whole(path: str, content: str) -> None:
    """The file appears complete or not at all."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(content)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, path)

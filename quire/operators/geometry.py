"""Words on scanned pages: alignment of a text with recognised words, placement, and page figures.

All of it goes block by block and depends on order within one, so a block is one task's group; blocks are a page's at most.
"""

from __future__ import annotations

import difflib
import re
import statistics
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import increasing

#: Least likeness of a pair by place, largest gap that is aligned, share of words that must be placed.
PAIR, GAP, COVERED = 0.5, 40, 0.6


def key(word: str) -> str:
    """STR-15."""
    from .extraction import folded

    return re.sub(r"[\W_]", "", folded(word))


def tokenize(text: str) -> list[tuple[str, int, int, str]]:
    """STR-15: words with their places and keys."""
    return [(m[0], m.start(), m.end(), key(m[0])) for m in re.finditer(r"\S+", text)]


def ratio(a: str, b: str) -> float:
    """STR-17."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


class Share(NamedTuple):
    """A part of a recognised word, from and to as shares of its width in reading direction."""

    word: int
    low: float = 0.0
    high: float = 1.0


def likeness(a: list[str], b: list[str], i: int, j: int, m: int, n: int) -> float:
    """How well the m words before a[i] and the n before b[j] agree when read as one; small gaps with as many words on
    either side agree place by place."""
    if len(a) == len(b) <= 3 and i == j and m == n == 1:
        return 1.0
    return ratio("".join(a[i - m : i]), "".join(b[j - n : j]))


def matched(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Word groups (i, m, j, n) that stand for each other, with the largest sum of likeness above PAIR; one word may be read
    as two, or two as one. A word left out on either side costs a tenth."""
    if max(len(a), len(b)) > GAP:
        return []
    moves = ((1, 1), (1, 2), (2, 1))
    score = [[-0.1 * (i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    last: list[list[tuple[int, int]]] = [[(1, 0) if i else (0, 1) for _ in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            options = [(score[i - 1][j] - 0.1, (1, 0)), (score[i][j - 1] - 0.1, (0, 1))]
            options += [(score[i - m][j - n] + like - PAIR, (m, n)) for m, n in moves if m <= i and n <= j and (like := likeness(a, b, i, j, m, n)) >= PAIR]
            score[i][j], last[i][j] = max(options)
    groups, i, j = [], len(a), len(b)
    while i or j:
        m, n = last[i][j]
        i, j = i - m, j - n
        if m and n:
            groups.append((i, m, j, n))
    return groups[::-1]


def align(source: list[str], read: list[str]) -> dict[int, list[Share]]:
    """GEO-01: for each word key of the source the recognised words, or parts of them, that it is, in reading order."""
    out: dict[int, list[Share]] = {}
    at_source = at_read = 0
    for x, y, n in difflib.SequenceMatcher(None, source, read, autojunk=False).get_matching_blocks():
        for i, m, j, k in matched(source[at_source:x], read[at_read:y]):
            i, j = i + at_source, j + at_read
            # Source words that were read as one have parts of its box, by their lengths.
            sizes = [len(w) for w in source[i : i + m]]
            ends = [sum(sizes[:q]) / max(1, sum(sizes)) for q in range(m + 1)]
            for q in range(m):
                out[i + q] = [Share(j + r, *((ends[q], ends[q + 1]) if m > 1 else ())) for r in range(k)]
        out |= {x + q: [Share(y + q)] for q in range(n)}
        at_source, at_read = x + n, y + n
    out = {i: shares for i, shares in out.items() if source[i]}
    # Reading goes forwards: what would step back is left out.
    at = sorted(out)
    keep = increasing([(out[i][0].word, out[i][0].low) for i in at])
    return {at[k]: out[at[k]] for k in keep}


def reading_order(words: list[tuple], rtl: bool) -> list[tuple]:
    """Recognised words (text, x0, y0, x1, y1) row by row, each row from its reading side."""
    if not words:
        return []
    order = sorted(words, key=lambda w: w[2] + w[4])
    near = statistics.median(w[4] - w[2] for w in words) / 2
    row, rows, first = -1, [], None
    for w in order:
        middle = (w[2] + w[4]) / 2
        if first is None or middle - first > near:
            row, first = row + 1, middle
        rows.append((row, -w[3] if rtl else w[1], w))
    return [w for *_, w in sorted(rows, key=lambda r: r[:2])]


def box_of(shares: list[Share], words: list[tuple], rtl: bool) -> tuple[float, float, float, float]:
    """The box around parts of recognised words."""
    boxes = []
    for s in shares:
        _, x0, y0, x1, y1 = words[s.word]
        low, high = (1 - s.high, 1 - s.low) if rtl else (s.low, s.high)
        boxes.append((x0 + (x1 - x0) * low, y0, x0 + (x1 - x0) * high, y1))
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def place(text: str, words: list[tuple], box: tuple, rtl: bool) -> tuple[list[tuple], float]:
    """GEO-02: (start, end, x0, y0, x1, y1, sure) of each word of a block, and the share that was aligned.

    Recognised words (text, x0, y0, x1, y1) are read row by row. Words without a partner share the room between their placed
    neighbours of the row in proportion to their lengths; under the least share the whole block is laid out so.
    """
    tokens = tokenize(text)
    if not tokens:
        return [], 0.0
    words = reading_order(words, rtl)
    found = align([t[3] for t in tokens], [key(w[0]) for w in words])
    share = len(found) / len(tokens)
    if share < COVERED:
        found = {}
    out: list[tuple | None] = [(*box_of(found[i], words, rtl), True) if i in found else None for i in range(len(tokens))]
    i = 0
    while i < len(tokens):
        if out[i] is not None:
            i += 1
            continue
        k = i
        while k < len(tokens) and out[k] is None:
            k += 1
        left, right = (out[i - 1] if i else None), (out[k] if k < len(tokens) else None)
        same_row = left and right and min(left[3], right[3]) > max(left[1], right[1])
        x0, y0, x1, y1 = box
        if same_row:
            x0, x1 = (right[2], left[0]) if rtl else (left[2], right[0])
            y0, y1 = min(left[1], right[1]), max(left[3], right[3])
        elif left or right:
            y0, y1 = (left or right)[1], (left or right)[3]
        if x1 < x0:
            x0, x1 = x1, x0
        sizes = [max(1, t[2] - t[1]) for t in tokens[i:k]]
        at, total = 0, sum(sizes)
        for n, size in enumerate(sizes):
            a, b = at / total, (at + size) / total
            a, b = (1 - b, 1 - a) if rtl else (a, b)
            out[i + n] = (x0 + (x1 - x0) * a, y0, x0 + (x1 - x0) * b, y1, False)
            at += size
        i = k
    return [(t[1], t[2], *o) for t, o in zip(tokens, out, strict=True)], share


PLACED = "page_id long, block string, start int, end int, x0 double, y0 double, x1 double, y1 double, sure boolean, coverage double"


def placed_words(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """GEO-01, GEO-02: words of blocks (page_id, block, text, x0, y0, x1, y1, rtl) with boxes from recognised words
    (page_id, block, seq, text, x0, y0, x1, y1)."""

    def run(k, block, found):
        import pandas as pd

        b = block.iloc[0]
        got = [(r.text, r.x0, r.y0, r.x1, r.y1) for r in found.sort_values("seq").itertuples()]  # seq settles ties
        rows, share = place(b.text or "", got, (b.x0, b.y0, b.x1, b.y1), bool(b.rtl))
        names = [c.split(" ")[0] for c in PLACED.split(", ")]
        return pd.DataFrame([(b.page_id, b.block, *r, share) for r in rows], columns=names)

    return blocks.groupBy("page_id", "block").cogroup(words.groupBy("page_id", "block")).applyInPandas(run, PLACED)


def page_figures(placed: DataFrame) -> DataFrame:
    """GEO-03: blocks of each page, those under the least share, and the mean share."""
    one = placed.groupBy("page_id", "block").agg(F.max("coverage").alias("coverage"))
    return one.groupBy("page_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("coverage") < COVERED).alias("low_coverage"), F.avg("coverage").alias("mean_coverage"))


def merged_passes(lines: list[dict], cover: float = 0.5) -> list[dict]:
    """GEO-04: lines (y0, y1, words) of several recognition passes: of lines that cover each other by half, that with more words."""
    kept: list[dict] = []
    for line in lines:
        for k, other in enumerate(kept):
            common = min(line["y1"], other["y1"]) - max(line["y0"], other["y0"])
            if common >= cover * min(line["y1"] - line["y0"], other["y1"] - other["y0"]):
                if line["words"] > other["words"]:
                    kept[k] = line
                break
        else:
            kept.append(line)
    return sorted(kept, key=lambda x: x["y0"])


def passes(lines: DataFrame) -> DataFrame:
    """GEO-04 for pages: rows (page_id, pass, y0, y1, words)."""

    def run(pdf):
        import pandas as pd

        rows = merged_passes(pdf.sort_values(["pass", "y0"]).to_dict("records"))
        return pd.DataFrame(rows, columns=pdf.columns)

    return lines.groupBy("page_id").applyInPandas(run, lines.schema)

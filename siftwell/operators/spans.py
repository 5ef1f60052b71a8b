"""Places in whole texts: lines of offsets, Markdown regions as intervals, and matches that cross lines.

Texts are matched whole, by built-in functions; only those with a match go on
to Arrow tasks, where an ordered array of line starts turns offsets into lines
and columns by binary search, and ordered intervals tell the region of each
offset. Offsets count code points from 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import found_at, one_of, settled

#: Regions, weakest first: where two overlap the later one counts. Fixed values.
REGIONS = ["prose", "frontmatter", "code", "inline-code", "hidden"]
#: What hides text from readers of rendered Markdown, beside comments: styles and attributes of an opening tag. Fixed values.
HIDING = r"\bhidden\b|display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|opacity\s*:\s*0(?:\.0+)?\b"
#: Elements that may hide text. Fixed values.
ELEMENTS = "div span p section small font"
_FENCE = re.compile(r" {0,3}(?P<mark>`{3,}|~{3,})[ \t]*(?P<info>[^`\s]*)")
_FRONT = re.compile(r"\A\ufeff?---[ \t]*\r?\n(?:.*?\r?\n)?---[ \t]*(?:\r?\n|\Z)", re.S)
#: What opens a region outside of code; each kind finds its own end.
_OPENING = re.compile(
    rf"(?P<comment><!--)|(?<!`)(?P<ticks>`+)(?!`)|^[ ]{{0,3}}(?P<definition>\[[^\]\n]*\]:[ \t]*(?:\#|<>|//)[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^)\n]*\))[ \t]*$)|<(?P<tag>{'|'.join(ELEMENTS.split())})\b(?=[^>]*?(?:{HIDING}))[^>]*>",
    re.M | re.I,
)


def line_starts(text: str) -> np.ndarray:
    """Offsets at which the lines of a text start; an empty text has one line."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate([[0], np.flatnonzero(points == 10) + 1])


def lines_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The line, from 0, of each offset: the last start that isn't behind it."""
    return np.searchsorted(starts, offsets, side="right") - 1


def front_matter(text: str) -> int:
    """Where the body starts behind the front matter; 0 without one."""
    found = _FRONT.match(text)
    return found.end() if found else 0


def _fences(text: str, begin: int) -> list[tuple[int, int, str]]:
    """Insides of fenced code from `begin` on, with the word behind the fence. An open one runs to the end."""
    out, mark, info, inside, at = [], "", "", 0, begin
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        fence = _FENCE.match(text, at, stop)
        if fence and not mark:
            mark, info, inside = fence["mark"], fence["info"].lower(), min(stop + 1, len(text))
        elif fence and fence["mark"][0] == mark[0] and len(fence["mark"]) >= len(mark) and not text[fence.end() : stop].strip() and not fence["info"]:
            out.append((inside, at, info))
            mark = ""
        at = stop + 1
    return [*out, (inside, len(text), info)] if mark else out


def intervals(text: str) -> list[tuple[str, int, int, str | None, str | None]]:
    """Region, start, end (exclusive), language of code and what hides it, in order of start: those of a Markdown text that aren't prose.

    One pass from left to right: what stands inside a span of code or inside
    what is hidden opens nothing. Comments and elements may run over lines; an
    open comment hides the rest, an open element nothing.
    """
    begin = front_matter(text)
    fences = _fences(text, begin)
    out = [("frontmatter", 0, begin, None, None)] if begin else []
    out += [("code", s, e, lang or None, None) for s, e, lang in fences if e > s]
    fence_starts, at, never_closed = [s for s, _, _ in fences], begin, set()
    while found := _OPENING.search(text, at):
        start = found.start()
        k = bisect_right(fence_starts, start) - 1
        if k >= 0 and start < fences[k][1]:
            at = max(fences[k][1], start + 1)
            continue
        if found["comment"]:
            close = text.find("-->", start + 4)
            at = len(text) if close < 0 else close + 3
            out.append(("hidden", start, at, None, "html-comment"))
        elif ticks := found["ticks"]:
            at = found.end()
            stop = text.find("\n", at)
            close = re.compile(rf"(?<!`)`{{{len(ticks)}}}(?!`)").search(text, at, len(text) if stop < 0 else stop)
            if close:
                at = close.end()
                out.append(("inline-code", start, at, None, None))
        elif found["definition"]:
            at = found.end()
            out.append(("hidden", found.start("definition"), at, None, "link-definition"))
        else:
            at, tag = found.end(), found["tag"].lower()
            close = None if tag in never_closed else re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            if close:
                at = close.end()
                out.append(("hidden", start, at, None, "hidden-element"))
            else:
                never_closed.add(tag)
    return sorted(out, key=lambda r: (r[1], -r[2]))


def regions_at(spans: list[tuple], offsets: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """For each offset the place in REGIONS of the strongest interval that holds it, and the language of code there.

    The intervals of a kind don't overlap: of each, the last one that starts
    before an offset is the only one that may hold it.
    """
    best, lang = np.zeros(len(offsets), np.int64), [None] * len(offsets)
    for place, kind in enumerate(REGIONS[1:], 1):
        own = [s for s in spans if s[0] == kind]
        if not own:
            continue
        k = np.searchsorted([s[1] for s in own], offsets, side="right") - 1
        held = (k >= 0) & (offsets < np.array([s[2] for s in own])[k])
        best[held] = place
        if kind == "code":
            for i in np.flatnonzero(held):
                lang[i] = own[k[i]][3]
    return best, lang


def markdown_regions(files: DataFrame, key: str = "file_id") -> DataFrame:
    """key, region, via, lang, start, end, first_line and last_line of all regions of Markdown texts (kinds skill-md and markdown) but prose. Null and empty texts have none."""
    rows = files.filter(F.col("kind").isin("skill-md", "markdown") & (F.length("text") > 0)).select(key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, found, lines = [], [], []
            for i, text in enumerate(b.column("text")):
                text = text.as_py()
                spans = intervals(text)
                if spans:
                    owner += [i] * len(spans)
                    found += spans
                    lines += (lines_of(line_starts(text), np.array([[s, max(s, e - 1)] for _, s, e, _, _ in spans])) + 1).tolist()
            columns = [pa.array([s[k] for s in found], t) for k, t in ((0, pa.string()), (4, pa.string()), (3, pa.string()), (1, pa.int32()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(owner, pa.int64())), *columns, *[pa.array([x[k] for x in lines], pa.int32()) for k in (0, 1)]], [key, "region", "via", "lang", "start", "end", "first_line", "last_line"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, region string, via string, lang string, start int, end int, first_line int, last_line int")


#: A line break within a paragraph: no blank line, list item, heading, quotation, table or fence follows. Taken for a space, it leaves all offsets as they are.
WRAP = r"\n(?![ \t]*(?:\n|[-*+#>|<]|\d+[.)]|```|~~~|\z))"


def unwrapped(text: Column) -> Column:
    """text with the line breaks within its paragraphs as spaces; as long as before."""
    return F.regexp_replace(text, WRAP, " ")


def text_matches(rows: DataFrame, patterns: list[str], places: str, text: str) -> DataFrame:
    """A row for each row and each of its `places` (an array of places in patterns), with hits: array of rule (that place), offset and matched, of the pattern over the whole text. No shuffle, no Python."""
    each = rows.withColumn("_rule", F.explode(places))
    matches = one_of(F.col("_rule"), [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])
    both = settled(each, _m=matches, _p=one_of(F.col("_rule"), [F.split(text, p, -1) for p in patterns]))
    made = F.transform(found_at(F.col("_m"), F.col("_p")), lambda x: F.struct(F.col("_rule").alias("rule"), x["at"].alias("offset"), x["matched"].alias("matched")))
    return both.filter(F.size("_m") > 0).withColumn("hits", made).drop("_rule", "_m", "_p")


def placed(rows: DataFrame, key: str = "file_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each of rows' hits: key, kept columns, rule, offset, line and column (both from 1), last_line, matched, and line_text: the lines that the match touches, as one line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, out = [], []
            for i, (text, hits) in enumerate(zip(b.column("text"), b.column("hits"), strict=True)):
                text, hits = text.as_py(), hits.as_py()
                if not hits:
                    continue
                starts = line_starts(text)
                first = np.array([h["offset"] for h in hits])
                last = lines_of(starts, first + np.array([max(len(h["matched"]) - 1, 0) for h in hits]))
                line = lines_of(starts, first)
                for h, s, e in zip(hits, line, last, strict=True):
                    stop = int(starts[e + 1]) - 1 if e + 1 < len(starts) else len(text)
                    out.append((h["rule"], h["offset"], int(s) + 1, h["offset"] - int(starts[s]) + 1, int(e) + 1, h["matched"], text[int(starts[s]) : stop].replace("\n", " ")))
                owner += [i] * len(hits)
            kinds = [pa.int32()] * 5 + [pa.string()] * 2
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in (key, *keep)], *columns], [key, *keep, "rule", "offset", "line", "column", "last_line", "matched", "line_text"])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.filter(F.size("hits") > 0).select(key, *keep, "text", "hits").mapInArrow(run, f"{kept}, rule int, offset int, line int, column int, last_line int, matched string, line_text string")


_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s")
_BREAKS = re.compile(r"\s*(?:[-*+]\s|\d+[.)]\s|#|\||```)")
_LABEL = re.compile(r"\s*#{1,6}\s|\s*\*\*[^*]+\*\*:?\s*$")
LOOK_BACK = 40


def hangs_on(lines: list[str], i: int) -> str:
    """What line i (from 0) reads as a part of: the line above where that ends in a colon, the sentence that wraps onto it, and the heading or lead-in of its list within LOOK_BACK lines."""
    above = lines[i - 1] if i else ""
    out = []
    if above.rstrip().endswith(":"):
        out.append(above)
    elif above.strip() and above.rstrip()[-1] not in ".!?" and not _BREAKS.match(lines[i]):
        out.append(re.split(r"[.!?]", above)[-1])
    if _ITEM.match(lines[i]):
        for k in range(i - 1, max(i - 1 - LOOK_BACK, -1), -1):
            line = lines[k]
            if not line.strip() or _ITEM.match(line) or re.match(r"\s{2,}\S", line):
                continue
            if _LABEL.match(line) or (line.rstrip().endswith(":") and len(line.strip()) <= 80):
                out.append(line)
            break
    return "\n".join(out)


def contexts(files: DataFrame, hits: DataFrame) -> DataFrame:
    """file_id, line, at, region, lang and lead (see hangs_on) of the places of hits (file_id, line, at): a text is opened once, and only if it has a hit.

    Files of other kinds than Markdown are code throughout.
    """
    wanted = hits.groupBy("file_id").agg(F.collect_set(F.struct("line", "at")).alias("places"))  # as many as the text has matches
    rows = files.select("file_id", "kind", "text").join(wanted, "file_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, out = [], []
            for i, (kind, text, places) in enumerate(zip(b.column("kind"), b.column("text"), b.column("places"), strict=True)):
                kind, text, places = kind.as_py(), text.as_py(), places.as_py()
                starts, lines = line_starts(text), text.split("\n")
                offsets = np.array([int(starts[p["line"] - 1]) + p["at"] for p in places])
                if kind in ("skill-md", "markdown"):
                    best, lang = regions_at(intervals(text), offsets)
                else:
                    best, lang = np.full(len(places), REGIONS.index("code")), [None] * len(places)
                out += [(p["line"], p["at"], REGIONS[k], x, hangs_on(lines, p["line"] - 1)) for p, k, x in zip(places, best, lang, strict=True)]
                owner += [i] * len(places)
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("file_id").take(pa.array(owner, pa.int64())), *[pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]], ["file_id", "line", "at", "region", "lang", "lead"])

    kind = files.schema["file_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"file_id {kind}, line int, at int, region string, lang string, lead string")

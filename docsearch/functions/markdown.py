"""Repairs of converted Markdown: inline-code marks as one expression over the whole text, heading levels from a scan of it.

Both read a text as a sequence of regions, of which fenced code is one kind that nothing changes: a region runs from a fence line
to the next one, or to the end.  ``inline_code`` is a Column expression; ``strip_inline_code`` applies the same pattern to a string.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("off", "symbolic", "all")
# Patterns that results depend on.
BOLD = re.compile(r"\*\*(.+?)\*\*")
PART = re.compile(r"^\d+\s*부[.\s:]")
CHAPTER = re.compile(r"^(제\s*)?\d+\s*장[.\s:]|^chapter\s+\d+\b|^부록(\s|$|[A-Za-z~])", re.I)
NUMBERED = re.compile(r"^\d+(\.\d+)*[.)]\s")
SENTENCE = re.compile(r"(:|다\.|요\.|니다\.)$")
OPEN_ENDED = (",", "·", "&", "—", "-", "및")

_FENCE = r"[^\S\n]*(?:```|~~~)[^\n]*$"
_FENCED = rf"^{_FENCE}[\s\S]*?(?:\n{_FENCE}|\z)"
_TITLE = r"^(?P<mark>#{1,6})[^\S\n]+(?P<title>[^\n]*)$"
_REGIONS = regex.compile(rf"(?m)(?P<fenced>{_FENCED})|{_TITLE}".replace(r"\z", r"\Z"))
_TITLES = re.compile(rf"(?m){_TITLE}")


def _spans(mode: str) -> str:
    """Regions that stay (group 1: fenced code, a span that would make a heading of its line), spans that lose their marks (2), spans that stay (3)."""
    inside = r"[^`\n|\p{L}]" if mode == "symbolic" else r"[^`\n|]"
    return rf"({_FENCED}|^[^\S\n]*`[^\S\n]*#[^`\n]*`(?!`))|(?<!`)`({inside}+)`(?!`)|((?<!`)`[^`\n]+`(?!`))"


def _known(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}: {mode!r}")
    return mode


_SPANS = {mode: regex.compile(f"(?m){_spans(mode)}".replace(r"\z", r"\Z")) for mode in MODES[1:]}


def strip_inline_code(text: str, mode: str = "symbolic") -> tuple[str, int]:
    """Text without the back-ticks around inline code, and how many spans lost them."""
    if _known(mode) == "off":
        return text, 0
    out = _SPANS[mode].sub(lambda m: m[1] or m[2] or m[3] or "", text)
    return out, (len(text) - len(out)) // 2


def inline_code(x: Column, mode: str = "symbolic") -> Column:
    """struct(text, removed): ``strip_inline_code`` as an expression; null stays null."""
    out = x if _known(mode) == "off" else F.regexp_replace(x, f"(?mdU){_spans(mode)}", "$1$2$3")
    return F.struct(out.alias("text"), ((F.length(x) - F.length(out)) / 2).cast("int").alias("removed"))


def clean_header(x: str) -> str:
    return " ".join(re.sub(r"\s+#+\s*$", "", re.sub(r"\*\*|__|\*|_|`", "", x)).split())


def titles_of(line: str) -> list[str]:
    """The titles that stand on one heading line: each bold run if there is nothing else, else the whole.

    Runs are told apart where one does not end in what asks for more.
    """
    if not BOLD.search(line) or BOLD.sub("", line).strip():
        return [clean_header(line)]
    runs = [x for x in map(clean_header, BOLD.findall(line)) if x]
    ends = [k for k, x in enumerate(runs, 1) if k == len(runs) or not x.endswith(OPEN_ENDED)]
    return [" ".join(runs[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


#: (pattern, level, counter), the first that is found; then what a title is before the first chapter, with a number, and without.
_RULES = ((PART, 0, "parts_demoted"), (CHAPTER, 1, "chapters"), (SENTENCE, 0, "demoted"))
_BEFORE, _NUMBERED, _PLAIN = (1, "chapters"), (3, "subsections"), (2, "sections")
_COUNTERS = ("chapters", "sections", "subsections", "demoted", "parts_demoted")


def restore_headings(text: str, min_chapters: int = 2, flat_ratio: float = 0.9) -> tuple[str, dict[str, int]]:
    """Heading levels from their numbering, where nearly all are of one level and chapters can be told.

    Level 0 is bold text.  What counts for the condition are all heading lines, what is rewritten those outside of fenced code.
    """
    lines = list(_TITLES.finditer(text))
    chapters = sum(bool(CHAPTER.match(t)) for m in lines for t in titles_of(m["title"]))
    common = max(Counter(len(m["mark"]) for m in lines).values(), default=0)
    if not lines or common < flat_ratio * len(lines) or chapters < min_chapters:
        return text, {"applied": 0}
    found = [(m, titles_of(m["title"])) for m in _REGIONS.finditer(text) if m["fenced"] is None]
    table = [(k, t, next(((level, what) for test, level, what in _RULES if test.search(t)), None)) for k, (_, titles) in enumerate(found) for t in titles]
    first = next((k for k, (_, _, rule) in enumerate(table) if rule == (1, "chapters")), len(table))
    seen, new = Counter(), [[] for _ in found]
    for k, (line, title, rule) in enumerate(table):
        level, what = rule or (_BEFORE if k < first else _NUMBERED if NUMBERED.match(title) else _PLAIN)
        seen[what] += 1
        new[line].append(f"{'#' * level} {title}\n" if level else f"**{title}**\n")
    out, at = [], 0
    for (m, _), titles in zip(found, new, strict=True):
        # a line without a title leaves nothing, not even its end
        out += [text[at : m.start()], "\n".join(titles)]
        at = m.end() if titles else m.end() + 1
    body = "".join([*out, text[at:]])
    if at > len(text):  # the last line was one
        body = body.removesuffix("\n")
    return body, {"applied": 1, **{c: seen[c] for c in _COUNTERS}}


def headings(x: Column) -> Column:
    """struct(text, stats): ``restore_headings`` with its defaults."""

    @F.arrow_udf("struct<text:string,stats:map<string,int>>")
    def run(values: pa.Array) -> pa.Array:
        out = [(None, None) if v is None else restore_headings(v) for v in values.to_pylist()]
        stats = pa.array([None if s is None else list(s.items()) for _, s in out], pa.map_(pa.string(), pa.int32()))
        return pa.StructArray.from_arrays([pa.array([t for t, _ in out], pa.string()), stats], ["text", "stats"])

    return run(x)

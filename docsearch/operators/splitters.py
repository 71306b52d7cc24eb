"""The two text splitters that chunk borders depend on, as plain functions for use inside Arrow operators."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Sequence

#: Separators of the recursive splitter, in the order in which they are tried.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "。", ", ", " ", "")


def cut_after(text: str, separator: str) -> list[str]:
    """Pieces that end with the separator; without one, single characters."""
    return re.findall(rf"(?s).*?{re.escape(separator)}|.+\Z", text) if separator else list(text)


def pack(pieces: Iterable[str], size: int, overlap: int) -> list[str]:
    """Pieces joined up to a size; each chunk begins with what fits of the end of the one before."""
    out: list[str] = []
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if held + len(piece) > size and window:
            out.append("".join(window).strip())
            while held > overlap or (held and held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    out.append("".join(window).strip())
    return [x for x in out if x]


def recursive(text: str, size: int, overlap: int = 0, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` code points, cut at the first separator that the text has, longer pieces at later ones."""
    at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, later = separators[at], separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []

    def close() -> None:
        if short:
            out.extend(pack(short, size, overlap))
            short.clear()

    for piece in cut_after(text, separator):
        if len(piece) < size:
            short.append(piece)
        else:
            close()
            out.extend(recursive(piece, size, overlap, later) if later else [piece])
    close()
    return out


def by_headers(text: str, levels: dict[str, str]) -> list[tuple[dict[str, str], str]]:
    """(headers in force, content) of each section; levels: header mark to name, such as ``##`` to ``h2``.

    Lines are stripped of blanks and unprintable characters, paragraphs are joined by two spaces and a newline.  A piece
    that ends in a header line is joined to a following piece with more headers.
    """
    marks = sorted(levels, key=len, reverse=True)
    pieces: list[tuple[dict[str, str], list[str]]] = []
    held: list[str] = []
    stack: list[tuple[int, str, str]] = []
    current: dict[str, str] = {}
    fence = ""

    def close() -> None:
        if held:
            pieces.append((dict(current), held.copy()))
            held.clear()

    for raw in text.split("\n"):
        line = "".join(c for c in raw.strip() if c.isprintable())
        if fence:
            fence = "" if line.startswith(fence) else fence
        elif line.startswith("~~~") or (line.startswith("```") and line.count("```") == 1):
            fence = line[:3]
        if fence:
            held.append(line)
            continue
        mark = next((m for m in marks if line == m or line.startswith(m + " ")), None)
        if mark:
            while stack and stack[-1][0] >= mark.count("#"):
                stack.pop()
            stack.append((mark.count("#"), levels[mark], line[len(mark) :].strip()))
            close()
            held.append(line)
        elif line:
            held.append(line)
        else:
            close()
        current = {name: title for _, name, title in stack}
    close()

    out: list[tuple[dict[str, str], str]] = []
    for headers, content in ((h, "\n".join(c)) for h, c in pieces):
        if out:
            before, text_before = out[-1]
            dangling = text_before.rpartition("\n")[2].startswith("#")
            if before == headers or (len(before) < len(headers) and dangling):
                out[-1] = (headers, f"{text_before}  \n{content}")
                continue
        out.append((headers, content))
    return out

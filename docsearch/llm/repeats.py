"""Quality rules on repetition inside a text, by suffix arrays over words.

Per text, a suffix array over its words is built by prefix doubling (only groups that are still tied are sorted
again), the longest common prefixes of neighbours are found by bisection on prefix hashes, so that memory is a few numbers
a word.  Runs of neighbours with a common
prefix of at least ``MIN_REPEAT`` words are the LCP intervals; each suffix in one starts a maximal repeat as long as the
larger of its two common prefixes.  The union of these spans is the covered part.  Many texts share one array
of a piece: a word's first rank holds its row too, so that no repeat crosses texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.llm import textkit
from docsearch.llm.common import arrow_batches, tidy

#: A repeat counts from so many words; more than this share of the words covered, or one repeat longer than that, rejects.
MIN_REPEAT, MOST_COVERED, LONGEST = 8, 0.40, 100
MIN_WORDS, MOST_REPEATED = 50, 50
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, n_repeats long"


def _ranks(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of the suffix from each word on among all; a suffix that ends with its row comes before those that go on."""
    n = len(words)
    order = np.lexsort((words, rows))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step, size = 1, np.bincount(rank, minlength=n)
    tied = np.flatnonzero(size[rank] > 1)
    while len(tied):
        nxt = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)], -1)
        own = rank[tied]
        order = np.lexsort((nxt, own))
        own, nxt, at = own[order], nxt[order], tied[order]
        head = np.ones(len(at), bool)
        head[1:] = own[1:] != own[:-1]
        sub = head.copy()
        sub[1:] |= nxt[1:] != nxt[:-1]
        pos = np.arange(len(at))
        first = np.maximum.accumulate(np.where(head, pos, 0))
        mine = np.maximum.accumulate(np.where(sub, pos, 0))
        rank[at] = own + mine - first
        step *= 2
        group = np.cumsum(sub) - 1
        tied = np.sort(at[np.bincount(group)[group] > 1])
    return rank


def suffix_lcp(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp): lcp[k] is the common prefix, in words, of suffixes k - 1 and k (lcp[0] = 0)."""
    n = len(words)
    sa = np.empty(n, np.int64)
    sa[_ranks(rows, words)] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    k = np.flatnonzero((words[sa[1:]] == words[sa[:-1]]) & (rows[sa[1:]] == rows[sa[:-1]])) + 1
    a, b = sa[k - 1], sa[k]
    ends = np.cumsum(np.bincount(rows))[rows]
    power, inverse = textkit._grow(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)])
    # the first ``low`` words are equal, no more than ``high`` can be
    low, high = np.ones(len(k), np.int64), ends[a] - np.maximum(a, b)
    while len(live := np.flatnonzero(low < high)):
        x, y, half = a[live], b[live], (low[live] + high[live] + 1) // 2
        same = (total[x + half] - total[x]) * inverse[x] == (total[y + half] - total[y]) * inverse[y]
        low[live] = np.where(same, half, low[live])
        high[live] = np.where(same, high[live], half - 1)
    lcp[k] = low
    return sa, lcp


def repeats(rows: np.ndarray, words: np.ndarray, n_rows: int, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: words covered by repeats of at least so many words, the longest repeat, the number of maximal repeats."""
    n = len(words)
    if not n:
        return (np.zeros(n_rows, np.int64),) * 3
    sa, lcp = suffix_lcp(rows, words)
    own = np.maximum(lcp, np.append(lcp[1:], 0))
    length = np.empty(n, np.int64)
    length[sa] = own
    start = np.flatnonzero(length >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length[start], -1)
    covered = np.bincount(rows[np.cumsum(edge[:n]) > 0], minlength=n_rows)
    longest = np.zeros(n_rows, np.int64)
    np.maximum.at(longest, rows, length)
    # a repeat of two neighbours is maximal if it can't be extended to the left
    k = np.flatnonzero(lcp >= least)
    a, b = sa[k - 1], sa[k]
    extends = (a > 0) & (b > 0) & (rows[a - 1] == rows[a]) & (rows[b - 1] == rows[b]) & (words[a - 1] == words[b - 1])
    return covered, longest, np.bincount(rows[b[~extends]], minlength=n_rows)


def _duplicates(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of several, not the first of its group) for equal keys within a row."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((np.arange(len(key)), key, rows))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    group = np.cumsum(new) - 1
    many, later = np.empty(len(key), bool), np.empty(len(key), bool)
    many[order] = np.bincount(group)[group] > 1
    later[order] = ~new
    return many, later


def _measure(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> list[np.ndarray]:
    n = j - i
    b, s, e, rows = textkit.spans(raw, offsets, i, j)
    words = textkit.word_hashes(b, s, e, lower=False)
    at = offsets[i : j + 1] - offsets[i]
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    blank = textkit._SPACE[b]
    chars = total(((b & 0xC0) != 0x80) & ~blank)
    # lines with a word: from the border or newline before a word to the next
    cut = np.unique(np.concatenate([at[:-1], np.flatnonzero(b == 10) + 1]))
    cut = cut[cut < len(b)]
    stop = np.append(cut[1:], len(b))[: len(cut)]
    stop = stop - (b[stop - 1] == 10)
    seen = np.concatenate([[0], np.cumsum(~blank)])
    has = seen[stop] > seen[cut]
    cut, stop = cut[has], stop[has]
    line_rows = np.searchsorted(at, cut, "right") - 1
    _, later = _duplicates(textkit.word_hashes(b, cut, stop, lower=False), line_rows)
    # three-word windows
    w = np.flatnonzero(rows[:-2] == rows[2:]) if len(words) > 2 else np.zeros(0, np.int64)
    window = textkit.mix(words[w] * np.uint64(0xD6E8FEB86659FD93) + textkit.mix(words[w + 1] + textkit.mix(words[w + 2], 5), 6), 7)
    many, _ = _duplicates(window, rows[w])
    inside = np.zeros(len(words) + 2, bool)
    for k in range(3):
        inside[w[many] + k] = True
    count = lambda r: np.bincount(r, minlength=n)
    return [count(rows), chars, total(_SYMBOL[b]), count(line_rows[later]), count(rows[inside[: len(words)]]), *repeats(rows, words, n)]


def _columns(column: pa.Array) -> list[np.ndarray]:
    raw, offsets = textkit.buffers(column)
    parts = [_measure(raw, offsets, i, j) for i, j in textkit.pieces(offsets)]
    return [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 8


def _run(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _columns(batch.column(1)))], [x.split()[0] for x in SCHEMA.split(", ")])


def _verdict(n_words, n_repeat_words, covered_words, longest_repeat, most_covered: float, longest: int):
    """(base_failed, kept), of columns or of arrays."""
    failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)
    return failed, ~failed & (covered_words <= most_covered * n_words) & (longest_repeat <= longest)


def repetition(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_covered: float = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """A row for each row of docs: doc_id, the base counts, the repetition measures, base_failed and kept.

    Null, empty and blank texts have no words: all counts are 0, base_failed is true and kept is false.  Repeated rows
    give repeated results; a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
    A text is kept if the base rules hold, at most ``most_covered`` of its words lie in repeats of
    ``MIN_REPEAT`` words or more, and no repeat has more than ``longest`` words.
    """
    arrow_batches(docs.sparkSession)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(_run), SCHEMA)
    failed, kept = _verdict(*(F.col(c) for c in ("n_words", "n_repeat_words", "covered_words", "longest_repeat")), most_covered, longest)
    return out.withColumn("base_failed", failed).withColumn("kept", kept)


def accepted(docs: DataFrame, text: str = "text", most_covered: float = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """The rows of docs, with all their columns, that ``repetition`` keeps; nothing is shuffled."""
    arrow_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            m = _columns(batch.column(at))
            yield batch.filter(pa.array(_verdict(m[0], m[4], m[5], m[6], most_covered, longest)[1]))

    return docs.mapInArrow(tidy(run), docs.schema)

"""Blocks: documents as positions in a small word list, and the global distinct-word shuffle between the lists.

A block is a run of documents of about ``BLOCK_BYTES`` of text from one input partition.  Its tokens are exploded with
their positions into ranks in the block's own word list (in order of first use), kept as compressed byte planes: an
occurrence takes a byte or two, wherever it goes.  A block's words are dealt by hash into ``parts`` bundles, one row for
each; a task of the word shuffle sees every bundle of its part, so each distinct word of the corpus meets its equals
in one place.  Replies go back by block and are put together with the documents by position.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES, TASK_BYTES, MOST_PARTS = 4 << 20, 64 << 20, 8192


def squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack(a: np.ndarray, width: int = 4) -> bytes:
    """Non-negative integers as compressed byte planes."""
    if not len(a):
        return b""
    a = np.ascontiguousarray(a, "<u8" if width > 4 else "<u4")
    planes = a.view(np.uint8).reshape(len(a), -1)
    most = int(a.max())
    n = max(1, (most.bit_length() + 7) // 8)
    return bytes([n]) + squeeze(np.ascontiguousarray(planes[:, :n].T).tobytes())


def unpack(x: bytes) -> np.ndarray:
    if not x:
        return np.zeros(0, np.int64)
    n = x[0]
    planes = np.frombuffer(expand(x[1:]), np.uint8).reshape(n, -1)
    out = np.zeros(planes.shape[1], np.int64)
    for k in range(n):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def pack_words(words: list[bytes]) -> bytes:
    sizes = pack(np.array([len(w) for w in words], np.uint32))
    return len(sizes).to_bytes(4, "little") + sizes + squeeze(b"".join(words))


def unpack_words(x: bytes) -> list[bytes]:
    n = int.from_bytes(x[:4], "little")
    ends = np.cumsum(unpack(x[4 : 4 + n])).tolist()
    raw = expand(x[4 + n :])
    return [raw[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def checksum(hashes: np.ndarray, ranks: np.ndarray) -> int:
    return int((hashes * (2 * ranks.astype(np.uint64) + np.uint64(1))).sum(dtype=np.uint64).view(np.int64))


def widths(texts: DataFrame, column: str = "text") -> tuple[int, int]:
    """(tasks, parts) for a shuffle of blocks and of their words, from the counted bytes of the texts.

    The session's partitions are the least; beyond, a task has about ``TASK_BYTES`` of text.  A block's words are dealt into
    ``MOST_PARTS`` bundles at most, so that a bundle stays worth a row; parts are read as a stream.
    """
    total = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    tasks = max(2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    return tasks, min(tasks, MOST_PARTS)


class Block:
    """ids: of its documents, sizes: tokens of each, ranks: of all tokens, words: by rank, more: values by document."""

    def __init__(self, number: int, ids: list, sizes: list[int], ranks: np.ndarray, words: list, more: list) -> None:
        self.number, self.ids, self.sizes, self.ranks, self.words, self.more = number, ids, sizes, ranks, words, more

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def checksum(self, to_bytes: Callable = bytes) -> int:
        """Of the words with their ranks; those of the bundles add up to it."""
        return checksum(self._hashes([to_bytes(w) for w in self.words]), np.arange(len(self.words)))

    def bundles(self, parts: int, to_bytes: Callable = bytes, also: np.ndarray | None = None) -> Iterator[tuple]:
        """(part, ranks ascending, words, their checksum, values of ``also`` by rank) for each part that has words."""
        words = [to_bytes(w) for w in self.words]
        hashes = self._hashes(words)
        part = (hashes % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(at):
                yield int(part[at[0]]), at, [words[k] for k in at], checksum(hashes[at], at), None if also is None else also[at]


def blocks(batches, tokens: Callable, more: int = 0, positions: bool = True, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of an iterator of record batches (id, text, further columns); tokens: of a text, never None.

    Without positions a block has its words only, in the same order.
    """
    task, numbers = TaskContext.get(), count()
    first = (task.partitionId() if task else 0) << 32

    def fresh():
        return defaultdict(count().__next__), [], [], [], []

    def close():
        return Block(first | next(numbers), ids, sizes, np.concatenate(parts) if parts else np.zeros(0, np.int32), list(table), extra)

    (table, ids, sizes, parts, extra), held = fresh(), 0
    for batch in batches:
        texts, own = batch.column(1).to_pylist(), batch.column(0).to_pylist()
        others = list(zip(*(batch.column(2 + k).to_pylist() for k in range(more)), strict=True)) if more else [()] * len(own)
        for i, text, x in zip(own, texts, others, strict=True):
            found = tokens(text or "")
            if positions:
                parts.append(np.fromiter(map(table.__getitem__, found), np.int32, len(found)))
            else:
                table.update(dict.fromkeys(found))
            ids.append(i)
            sizes.append(len(found))
            extra.append(x)
            held += len(text or "")
            if held >= block_bytes:
                yield close()
                (table, ids, sizes, parts, extra), held = fresh(), 0
    if ids:
        yield close()


def ragged(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the lists ``at`` one after the other, the lists' sizes)."""
    size = offsets[at + 1] - offsets[at]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(offsets[at] - ends + size, size) + np.arange(total)], size


def record(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

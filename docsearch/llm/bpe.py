"""Byte-level BPE encoding and decoding with a global distinct-word shuffle.

Documents are cut into pre-tokens (each match of the pattern); blocks hold them as positions in their word list (see
``blocks``).  The lists' words are dealt by hash, so that each distinct pre-token of the corpus is encoded once; its ids
go back to the blocks that have it and are put in place by position.  Positions cross the network once, words and ids once
per block, and no text does.  Decoding joins ids with the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsearch.llm.blocks import blocks, pack, pack_words, ragged, record, unpack, unpack_words, widths
from docsearch.llm.common import arrow_batches, give_back, tidy


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_made: dict[int, tiktoken.Encoding] = {}


def _encoder(held) -> tiktoken.Encoding:
    """One encoder for each worker process; a whole pre-token is one piece."""
    if held.value["key"] not in _made:
        _made[held.value["key"]] = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=held.value["ranks"], special_tokens={})
    return _made[held.value["key"]]


def _hold(df: DataFrame, ranks: dict[bytes, int]):
    return df.sparkSession.sparkContext.broadcast({"key": hash(frozenset(ranks.items())), "ranks": ranks})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs: what tiktoken's encode_ordinary gives.

    Null and empty texts have no ids; repeated rows get repeated results, null ids stay null, other columns are
    ignored, an empty table gives an empty result.  Both reads of ``docs`` must give the same rows in the same
    order, as a table's scan does; a block that meets another word list than its own is an error (a 64-bit checksum of the list tells).
    Very long texts are blocks of their own.
    """
    return _encoded(docs, ranks, pattern, lambda doc_ids, lists: pa.table([doc_ids, lists], ["doc_id", "ids"]), "doc_id long, ids array<int>", doc_id, text)


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, finish: Callable[[pa.Array, pa.ListArray], pa.Table], schema: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``finish`` makes of the documents' ids and their lists of tokens, some documents at a time, in the worker that puts these together."""
    spark = docs.sparkSession
    arrow_batches(spark)
    held = _hold(docs, ranks)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tasks, parts = widths(src)
    to_bytes = str.encode

    def positions(batches):
        find = regex.compile(pattern).findall
        for b in blocks(batches, find):
            yield record(
                ["block", "n_words", "check", "ids", "sizes", "ranks"],
                [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()],
                [(b.number, len(b.words), b.checksum(to_bytes), b.ids, pack(np.array(b.sizes, np.uint32)), pack(b.ranks))],
            )

    def words(batches):
        find = regex.compile(pattern).findall
        for b in blocks(batches, find, positions=False):
            rows = [(p, b.number, pack(np.diff(at, prepend=0)), pack_words(w), c) for p, at, w, c, _ in b.bundles(parts, to_bytes)]
            yield record(["part", "block", "at", "words", "check"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()], rows)

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what the part before has left
        encoder, seen = _encoder(held), {}
        for t in batches:
            rows = []
            for block, at, ws, check in zip(*(t[c].to_pylist() for c in ("block", "at", "words", "check")), strict=True):
                got = []
                for w in unpack_words(ws):
                    ids = seen.get(w)
                    if ids is None:
                        ids = seen[w] = encoder.encode_ordinary(w.decode())
                    got.append(ids)
                flat = np.fromiter((i for x in got for i in x), np.uint32)
                rows.append((block, at, pack(np.fromiter(map(len, got), np.uint32, len(got))), pack(flat), check))
            yield record(["block", "at", "sizes", "flat", "check"], [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()], rows)

    def reassemble(docs_: pa.Table, words_: pa.Table) -> pa.Table:
        give_back()  # what the block before has left
        if not docs_.num_rows:
            raise ValueError("a word list without its block: the input changed between two reads")
        n = docs_["n_words"][0].as_py()
        rank, size, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, s, f in zip(*(words_[c].to_pylist() for c in ("at", "sizes", "flat")), strict=True):
            rank.append(np.cumsum(unpack(at)))
            size.append(unpack(s))
            flat.append(unpack(f))
        rank, size, flat = (np.concatenate(x) for x in (rank, size, flat))
        check = sum(words_["check"].to_pylist()) - docs_["check"][0].as_py()
        if docs_.num_rows != 1 or check % (1 << 64) or len(rank) != n or (n and not np.array_equal(np.sort(rank), np.arange(n))):
            raise ValueError("a block and its word list differ: the input changed between two reads")
        # the bundles' order: word of rank r is the place[r]-th
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        offsets = np.concatenate([[0], np.cumsum(size)])
        flat = flat.astype(np.int32)
        ids, sizes, seq = docs_["ids"][0].values, unpack(docs_["sizes"][0].as_py()), unpack(docs_["ranks"][0].as_py())
        out = []
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        i = 0
        while i < len(sizes):  # some documents at a time
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + (1 << 17), "right")) - 1)
            values, n_ids = ragged(flat, offsets, place[seq[cuts[i] : cuts[j]]])
            ends = np.concatenate([[0], np.cumsum(n_ids)])[cuts[i : j + 1] - cuts[i]]
            out.append(finish(ids[i:j], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))))
            i = j
        return pa.concat_tables(out)

    packed = src.mapInArrow(tidy(positions), "block long, n_words long, check long, ids array<long>, sizes binary, ranks binary")
    listed = src.mapInArrow(tidy(words), "part long, block long, at binary, words binary, check long")
    coded = listed.repartition(tasks, "part").groupBy("part").applyInArrow(encode_part, "block long, at binary, sizes binary, flat binary, check long")
    both = packed.repartition(tasks, "block").groupBy("block").cogroup(coded.repartition(tasks, "block").groupBy("block"))
    return both.applyInArrow(reassemble, schema)


def _table(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Bytes by id; its size is that of the vocabulary."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _joined(lists: pa.ListArray, token: Callable[[int], bytes | str], by: bytes | str) -> Iterator[bytes | str]:
    """The tokens of each list, one after the other."""
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0))]).tolist()
    ids = lists.flatten().to_numpy().tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        yield by.join(map(token, ids[a:b]))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of each id one after the other, by the token-byte table.

    Null ids give null, an empty list empty bytes; an id outside the table is an error; other columns stay as they are.
    """
    at, held = encoded.columns.index(ids), encoded.sparkSession.sparkContext.broadcast(_table(ranks))

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            out = [x if has else None for x, has in zip(_joined(lists, held.value.__getitem__, b""), lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(tidy(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): of the encoded lists and of what they decode to, summed up where the lists are put together."""
    spark = docs.sparkSession
    tokens, numbers = (spark.sparkContext.broadcast(x) for x in (_table(ranks), list(map(str, range(max(ranks.values(), default=-1) + 1)))))

    def finish(doc_ids: pa.Array, lists: pa.ListArray) -> pa.Table:
        ids = [hashlib.sha256(x.encode()).hexdigest() for x in _joined(lists, numbers.value.__getitem__, " ")]
        texts = [hashlib.sha256(x).hexdigest() for x in _joined(lists, tokens.value.__getitem__, b"")]
        return pa.table([doc_ids, lists.value_lengths().cast(pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, ranks, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

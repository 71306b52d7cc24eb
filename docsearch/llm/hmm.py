"""A hidden Markov language model over word classes.

Tokens are words (A-Z lower-cased) and one end for each text.  A word's class is the word itself up to six bytes and its
first four and last three bytes beyond, hashed into ``CLASSES``; words seen once in training and all unseen words are
the class of rare words, the end is a class too.  So a state's emissions have a fixed size, while every word keeps a
probability of its own: p(word | state) = p(class | state) * p(word | class), where the second factor is the word's
smoothed count's share in its class (rare: half for the words seen once, half for the event of an unseen one).  All
probabilities of a state add up to 1.

Word counts are global: blocks (see ``blocks``) send their distinct words, dealt by hash, to be summed, and get counts and
classes back.  Baum-Welch counts over states, classes and transitions are summed across partitions, ``ROUNDS`` times
over all training texts, whole: of texts longer than ``SEGMENT`` the forward vectors at the segments' borders are found first, then the
segments are taken from the last to the first, so that memory does not grow with a text.  A score is the exact likelihood of the
whole text by the scaled forward recursion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.llm.blocks import blocks, pack, pack_words, record, unpack, unpack_words, widths
from docsearch.llm.common import arrow_batches, crc_mod, give_back, materialise, release, tidy

STATES, CLASSES, ROUNDS, PRIOR = 8, 1 << 14, 5, 20.0
#: Tokens of a text, of texts side by side, and of the short and long texts of a task that are gathered before.
SEGMENT, ABREAST, GATHER_SHORT, GATHER_LONG = 1024, 1 << 18, 1 << 20, 1 << 22
END, RARE, FIRST = 0, 1, 2


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only


def word_class(w: bytes) -> int:
    return FIRST + xxhash.xxh3_64_intdigest(w if len(w) <= 6 else w[:4] + b"\0" + w[-3:]) % CLASSES


def _emissions(cls: np.ndarray, start: np.ndarray, size: np.ndarray, t0: int, t1: int, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, emissions) of tokens t0 to t1 of the texts, times first; beyond a text's end its last token."""
    k = cls[start + np.minimum(np.arange(t0, t1)[:, None], size - 1)]
    return k, emit[k]


def forward(cls: np.ndarray, sizes: np.ndarray, m: dict) -> np.ndarray:
    """log10 likelihood of the class sequence of each text (all of size 1 or more), by the scaled recursion."""
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    start, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    if not len(order):
        return out
    a, total = np.tile(m["start"], (len(order), 1)), np.zeros(len(order))
    live = np.searchsorted(-size, -np.arange(int(size[0])), "left").tolist()  # texts of more than t tokens
    for t0 in range(0, len(live), 256):
        n0, t1 = live[t0], min(t0 + 256, len(live))
        _, b = _emissions(cls, start[:n0], size[:n0], t0, t1, m["emit"])
        c = np.ones((t1 - t0, n0))
        for t in range(t0, t1):
            n = live[t]
            a = (a[:n] @ m["move"] if t else a[:n]) * b[t - t0, :n]
            c[t - t0, :n] = x = a.sum(1)
            a /= x[:, None]
        total[:n0] += np.log10(c).sum(0)
    out[order] = total
    return out


def _expect(cls: np.ndarray, start: np.ndarray, size: np.ndarray, m: dict, counts: dict) -> None:
    """Adds the counts of texts side by side, longest first."""
    emit, move, first = (m[x].astype(np.float32) for x in ("emit", "move", "start"))
    live = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")
    borders = list(range(0, int(size[0]), SEGMENT))
    # forward vectors before each segment, of the texts that go on there
    before = [np.tile(first, (len(size), 1))]
    for t0 in borders[:-1]:
        n = int(live[t0 + SEGMENT])
        _, b = _emissions(cls, start[:n], size[:n], t0, t0 + SEGMENT, emit)
        x = before[-1][:n]
        for t in range(SEGMENT):
            x = (x @ move if t0 + t else x) * b[t]
            if t % 4 == 3:
                x /= x.sum(1, keepdims=True)
        before.append(x / x.sum(1, keepdims=True))
    carry = np.zeros((0, STATES), np.float32)
    for t0 in reversed(borders):
        t1 = min(t0 + SEGMENT, int(size[0]))
        ns = live[t0:t1].tolist()
        k, b = _emissions(cls, start[: ns[0]], size[: ns[0]], t0, t1, emit)
        a, scale = np.zeros_like(b), np.ones((t1 - t0, ns[0], 1), np.float32)
        x = edge = before.pop()
        for t, n in enumerate(ns):
            x = (x[:n] @ move if t0 + t else x[:n]) * b[t, :n]
            scale[t, :n] = c = x.sum(1, keepdims=True)
            x = a[t, :n] = x / c
        counts["loglik"] += float(np.log10(scale, dtype=np.float64).sum())
        b /= scale
        back = np.ones_like(b)
        back[-1, : len(carry)] = carry
        for t in range(len(ns) - 1, 0, -1):
            n = ns[t]
            b[t, :n] *= back[t, :n]
            back[t - 1, :n] = b[t, :n] @ move.T
            b[t, n:] = 0
        b[0] *= back[0]
        carry = b[0] @ move.T
        # b is now emission times backward vector over scale
        moved = a[:-1].reshape(-1, STATES).T @ b[1:].reshape(-1, STATES)
        if t0:
            moved += edge.T @ b[0]
        counts["move"] += moved * move
        a *= back
        if not t0:
            counts["start"] += a[0].sum(0, dtype=np.float64)
        flat = k.ravel()
        for j in range(STATES):
            counts["emit"][:, j] += np.bincount(flat, a[:, :, j].ravel(), minlength=FIRST + CLASSES)


def expect(cls: np.ndarray, sizes: np.ndarray, use: np.ndarray, m: dict, counts: dict) -> None:
    """Adds the Baum-Welch counts of the texts in use (all of size 1 or more)."""
    start, size = (np.cumsum(sizes) - sizes)[use], sizes[use]
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    i = 0
    while i < len(size):
        n = max(1, ABREAST // min(int(size[i]), SEGMENT))
        _expect(cls, start[i : i + n], size[i : i + n], m, counts)
        i += n


def _gathered(rows, m: dict, counts: dict) -> None:
    """``expect`` over (held, sizes, classes) of blocks; texts of several blocks go side by side, long ones and others apart."""
    held: dict[bool, list] = {False: [], True: []}

    def close(long: bool) -> None:
        if held[long]:
            cls = np.concatenate([x for x, _ in held[long]])
            size = np.concatenate([y for _, y in held[long]])
            held[long].clear()
            expect(cls, size, np.ones(len(size), bool), m, counts)

    for out, sizes, cls in rows:
        for long in (False, True):
            use = ~out & ((sizes > SEGMENT) == long)
            held[long].append((cls[np.repeat(use, sizes)].astype(np.int32), sizes[use]))
            if sum(len(x) for x, _ in held[long]) >= (GATHER_LONG if long else GATHER_SHORT):
                close(long)
    close(False)
    close(True)


def fresh_counts() -> dict:
    return {"emit": np.zeros((FIRST + CLASSES, STATES)), "move": np.zeros((STATES, STATES)), "start": np.zeros(STATES), "loglik": 0.0}


def first_model(share: np.ndarray) -> dict:
    """States that stay, with the overall class shares disturbed in each."""
    rng = np.random.default_rng(3)
    emit = share[:, None] * np.exp(rng.normal(0, 1.0, (len(share), STATES)))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    even = np.full(STATES, 1 / STATES)
    return {"emit": emit / emit.sum(0), "move": move, "start": even}


def maximise(counts: dict, share: np.ndarray) -> dict:
    emit = (counts["emit"] + PRIOR * share[:, None]) / (counts["emit"].sum(0) + PRIOR)
    move = counts["move"] + 0.1
    return {"emit": emit, "move": move / move.sum(1, keepdims=True), "start": (counts["start"] + 0.1) / (counts["start"] + 0.1).sum()}


_COUNTS = "key int, " + ", ".join(f"s{j} double" for j in range(STATES))


def _packed(docs: DataFrame, parts: int) -> DataFrame:
    bundle = pa.struct([("part", pa.int64()), ("at", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for b in blocks(batches, words, more=1):
            held = np.array([x[0] for x in b.more], bool)
            seen = np.bincount(b.ranks[np.repeat(~held, b.sizes)], minlength=len(b.words))
            rows = [{"part": p, "at": pack(np.diff(at, prepend=0)), "words": pack_words(w), "counts": pack(c)} for p, at, w, _, c in b.bundles(parts, also=seen)]
            yield record(
                ["block", "n_words", "ids", "held", "sizes", "ranks", "bundles"],
                [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.list_(bundle)],
                [(b.number, len(b.words), b.ids, held.tolist(), pack(np.array(b.sizes, np.uint32)), pack(b.ranks), rows)],
            )

    schema = "block long, n_words long, ids array<long>, held array<boolean>, sizes binary, ranks binary, bundles array<struct<part:long,at:binary,words:binary,counts:binary>>"
    return docs.mapInArrow(tidy(run), schema)


def _count(t: pa.Table) -> pa.Table:
    """Global counts and classes of the words of one part: a row for each bundle, and one for each class (block null)."""
    total: dict[bytes, int] = {}
    lists = []
    for ws, cs in zip(t["words"].to_pylist(), t["counts"].to_pylist(), strict=True):
        lists.append(unpack_words(ws))
        for w, c in zip(lists[-1], unpack(cs).tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    kind = {w: word_class(w) if c > 1 else RARE for w, c in total.items()}
    mass: dict[int, list[int]] = {}
    for w, c in total.items():
        if c:
            x = mass.setdefault(kind[w], [0, 0, 0])
            x[0] += c
            x[1] += 1
            x[2] += c + 1
    rows = [(b, at, pack(np.fromiter(map(total.__getitem__, ws), np.uint64, len(ws)), 8), pack(np.fromiter(map(kind.__getitem__, ws), np.uint32, len(ws))), None, None, None, None) for b, at, ws in zip(t["block"].to_pylist(), t["at"].to_pylist(), lists, strict=True)]
    rows += [(None, None, None, None, k, *x) for k, x in mass.items()]
    return pa.Table.from_batches([record(["block", "at", "counts", "kinds", "class", "n", "v", "mass"], [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], rows)])


def score(docs: DataFrame, states_rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Training takes the rows whose crc32(doc_id as text) mod 7 is not 2 (a null doc_id counts as empty text), scoring all.
    Null and empty texts are an end alone.  Repeated rows count and are scored as often as they come; other columns are
    ignored; an empty table gives an empty result.  Without training rows every token is unseen.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"))
    tasks, parts = widths(src)
    packed = materialise(_packed(src, parts), "blocks")
    schema = "block long, at binary, counts binary, kinds binary, class int, n long, v long, mass long"
    counted = materialise(packed.select("block", F.explode("bundles").alias("b")).select("block", "b.*").repartition(tasks, "part").groupBy("part").applyInArrow(_count, schema), "word-counts")
    # sums by class, CLASSES rows at most
    sums = counted.where("block is null").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("mass").alias("mass")).toPandas()
    texts = packed.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    n_train, v_train = int(sums["n"].sum()) + texts, int(sums["v"].sum()) + (texts > 0)
    floor = n_train + v_train + 1
    mass = np.ones(FIRST + CLASSES)
    share = np.zeros(FIRST + CLASSES)
    mass[sums["class"].to_numpy(int)] = sums["mass"].to_numpy(float)
    share[sums["class"].to_numpy(int)] = sums["n"].to_numpy(float)
    once = int(share[RARE])
    share[END], share[RARE] = max(texts, 1), max(once, 1)
    share /= share.sum()
    log_mass = np.log10(mass)
    log_mass[[END, RARE]] = 0

    def reassemble(b: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()  # what the block before has left
        if b.num_rows != 1:
            raise ValueError("a word list without its block")
        n = b["n_words"][0].as_py()
        c, kind = np.zeros(n, np.int64), np.full(n, -1)
        for at, x, k in zip(*(replies[i].to_pylist() for i in ("at", "counts", "kinds")), strict=True):
            at = np.cumsum(unpack(at))
            c[at], kind[at] = unpack(x), unpack(k)
        if (kind < 0).any():
            raise ValueError("a block without its whole word list")
        sizes, seq = unpack(b["sizes"][0].as_py()), unpack(b["ranks"][0].as_py())
        at = np.repeat(np.arange(len(sizes)), sizes)
        tally = lambda w: np.bincount(at, w[seq], minlength=len(sizes))
        lg, plain = np.log10(c + 1.0), kind >= FIRST
        end = np.log10(texts + 1.0)
        flat = np.insert(kind[seq], np.cumsum(sizes), END) if len(sizes) else kind[seq]
        values = [tally(lg) + end, tally(np.where(plain, lg, 0.0)), tally((c > 0) * 1.0) + (texts > 0), tally((c == 1) * 1.0), tally((c == 0) * 1.0)]
        columns = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in values]
        return pa.table([b["ids"], b["held"], pa.array([pack(sizes + 1)], pa.binary()), pa.array([pack(flat)], pa.binary()), *columns], ["ids", "held", "sizes", "classes", "log_all", "log_plain", "known", "once", "unseen"])

    schema = "ids array<long>, held array<boolean>, sizes binary, classes binary, log_all array<double>, log_plain array<double>, known array<double>, once array<double>, unseen array<double>"
    replies = counted.where("block is not null").select("block", "at", "counts", "kinds").repartition(tasks, "block")
    ready = packed.drop("bundles").repartition(tasks, "block").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(reassemble, schema)
    ready = materialise(ready, "classes")
    release(packed, counted)

    model = first_model(share)
    for _ in range(states_rounds if texts else 0):
        held = spark.sparkContext.broadcast(model)

        def step(batches, held=held):
            counts = fresh_counts()
            _gathered(((np.array(h.as_py(), bool), unpack(sizes.as_py()), unpack(cls.as_py())) for batch in batches for h, sizes, cls in zip(*batch.columns, strict=True)), held.value, counts)
            some = np.flatnonzero(counts["emit"].any(1))
            rows = np.concatenate([counts["emit"][some], counts["move"], counts["start"][None], np.eye(1, STATES) * counts["loglik"]])
            keys = np.concatenate([some, FIRST + CLASSES + np.arange(STATES + 2)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(rows[:, j]) for j in range(STATES))], ["key", *(f"s{j}" for j in range(STATES))])

        got = ready.select("held", "sizes", "classes").mapInArrow(tidy(step), _COUNTS).groupBy("key").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(STATES))).toPandas().set_index("key")
        full = got.reindex(np.arange(FIRST + CLASSES + STATES + 2), fill_value=0.0).to_numpy()
        k = FIRST + CLASSES
        model = maximise({"emit": full[:k], "move": full[k : k + STATES], "start": full[k + STATES]}, share)
        held.unpersist()
    held = spark.sparkContext.broadcast(model)
    log_once = np.log10(0.5 / once) if once else 0.0
    log_unseen = np.log10(0.5) if once else 0.0

    def final(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, h, sizes, cls = row[0], row[1], unpack(row[2]), unpack(row[3])
                log_all, log_plain, known, ones, unseen = (np.array(x) for x in row[4:])
                within = log_plain - np.bincount(np.repeat(np.arange(len(sizes)), sizes), log_mass[cls], minlength=len(sizes)) + ones * log_once + unseen * log_unseen
                out = [pa.array(ids, pa.int64()), pa.array(h, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known.astype(np.int64)), pa.array(np.full(len(sizes), n_train, np.int64)), pa.array(log_all - sizes * np.log10(floor)), pa.array(forward(cls, sizes, held.value) + within)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ready.mapInArrow(tidy(final), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

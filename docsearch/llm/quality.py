"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators (present or not) of hashed n-grams: words and pairs of words, and runs of one to
three word shapes (case, digits, symbols, punctuation, length class, and whether the word repeats the one before).
Each indicator is scaled by its class log-count ratio; a linear hinge-loss model is then fitted on the scaled,
unit-length rows by dual coordinate descent, and its margin is mapped to 0..1 by a logistic fit on margins of rows
that the model behind them has not seen.  The fit takes at most ``FIT_ROWS`` labelled rows (those with the
smallest hash of doc_id), the scoring every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.llm import textkit
from docsearch.llm.common import arrow_batches, crc_mod, give_back, tidy

BITS = 18
#: The bound of the fitting sample; beyond it accuracy no longer grows on such texts.
FIT_ROWS = 6000
ALPHA, BETA, C, EPOCHS, THRESHOLD = 1.0, 0.25, 1.0, 12, 0.3
_UPPER, _LOWERCASE, _DIGIT, _HIGH = (np.isin(np.arange(256), np.arange(a, b)) for a, b in ((65, 91), (97, 123), (48, 58), (128, 256)))
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:?'\"()-", np.uint8))
_OTHER = ~(_UPPER | _LOWERCASE | _DIGIT | _HIGH | _STOP | textkit._SPACE)


def _shapes(b: np.ndarray, s: np.ndarray, e: np.ndarray, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(s), np.uint64)
    for k, kind in enumerate((_UPPER, _LOWERCASE, _DIGIT, _HIGH, _STOP, _OTHER)):
        seen = np.concatenate([[0], np.cumsum(kind[b])])
        n = seen[e] - seen[s]
        out |= np.minimum(n, 2 if kind is _UPPER or kind is _OTHER else 1).astype(np.uint64) << np.uint64(2 * k)
    out |= np.minimum((e - s) // 8, 3).astype(np.uint64) << np.uint64(12)
    if len(s) > 1:
        out[1:] |= ((words[1:] == words[:-1]) & (rows[1:] == rows[:-1])).astype(np.uint64) << np.uint64(14)
    return out


def features(column: pa.Array):
    """Yields (i, j, rows, keys): the distinct feature numbers of each row, row by row; number 0 is in every row."""
    raw, offsets = textkit.buffers(column)
    for i, j in textkit.pieces(offsets):
        b, s, e, rows = textkit.spans(raw, offsets, i, j)
        words = textkit.word_hashes(b, s, e, lower=False)
        lowered = textkit.word_hashes(b, s, e)
        shapes = textkit.mix(_shapes(b, s, e, rows, lowered), 11)
        found, at = [textkit.mix(words, 12), shapes], [rows, rows]
        for gap, salt, grams in ((1, 13, words), (1, 14, shapes), (2, 15, shapes)):
            if len(rows) > gap:
                k = np.flatnonzero(rows[:-gap] == rows[gap:])
                h = grams[k]
                for d in range(1, gap + 1):
                    h = textkit.mix(h * np.uint64(3) + grams[k + d], salt)
                found.append(h)
                at.append(rows[k])
        key = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64) | (np.concatenate(at) << BITS)
        key = np.concatenate([key[(key & ((1 << BITS) - 1)) > 0], np.arange(j - i, dtype=np.int64) << BITS])
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        yield i, j, key >> BITS, key & ((1 << BITS) - 1)


def _descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hinge loss with an L2 penalty, by dual coordinate descent; rows are unit vectors of r at the given numbers."""
    w, a = np.zeros(len(r)), np.zeros(len(y))
    norm = [max(float(np.sqrt(r[x] @ r[x])), 1e-9) for x in rows]
    rng, live = np.random.default_rng(seed), np.arange(len(y))
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(live):
            x = rows[i]
            v = r[x] / norm[i]
            g = y[i] * (w[x] @ v) - 1
            new = min(max(a[i] - g, 0.0), cost[i])  # the rows' squared length is 1
            if new != a[i]:
                moved = max(moved, abs(new - a[i]))
                w[x] += (new - a[i]) * y[i] * v
                a[i] = new
        if moved < 1e-3:
            break
    return w


def _ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = np.full(1 << BITS, ALPHA), np.full(1 << BITS, ALPHA)
    for x, c in zip(rows, y, strict=True):  # numbers are distinct within a row
        (p if c > 0 else q)[x] += 1
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[0] = 1.0  # the constant
    return r


def _model(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = _ratios(rows, y)
    cost = np.where(y > 0, C * len(y) / (2 * (y > 0).sum()), C * len(y) / (2 * (y < 0).sum()))
    w = _descend(rows, y, r, cost)
    return r, (1 - BETA) * np.abs(w).mean() + BETA * w


def _margin(rows: np.ndarray, keys: np.ndarray, n: int, r: np.ndarray, w: np.ndarray) -> np.ndarray:
    top = np.bincount(rows, (r * w)[keys], minlength=n)
    return top / np.sqrt(np.maximum(np.bincount(rows, r[keys] ** 2, minlength=n), 1e-18))


def fit(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """Rows of feature numbers and labels of -1 or 1.  With one class only, the score is its smoothed share."""
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    prior = (n1 + 1) / (n1 + n0 + 2)
    if min(n1, n0) < 4:
        return {"r": np.ones(1 << BITS), "w": np.zeros(1 << BITS), "a": 0.0, "b": float(np.log(prior / (1 - prior)))}
    order = np.concatenate([np.flatnonzero(y > 0), np.flatnonzero(y < 0)])
    margin = np.empty(len(y))
    for k in (0, 1):
        inn, out = order[k::2], order[1 - k :: 2]
        r, w = _model([rows[i] for i in inn], y[inn])
        margin[out] = [(r[x] @ w[x]) / np.sqrt(r[x] @ r[x]) for x in (rows[i] for i in out)]
    # Platt's logistic fit with his smoothed targets
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = margin.std() or 1.0
    a, b = 1.0, 0.0
    for _ in range(50):
        z = margin / scale
        p = 1 / (1 + np.exp(-(a * z + b)))
        h = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        m = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    r, w = _model(rows, y)
    return {"r": r, "w": w, "a": float(a / scale), "b": float(b)}


def _extract(batches):
    for batch in batches:
        out = []
        for i, j, rows, keys in features(batch.column(1)):
            at = np.searchsorted(rows, np.arange(j - i + 1)).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(at), pa.array(keys.astype(np.int32))))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.concat_arrays(out), batch.column(2), batch.column(3)], ["doc_id", "keys", "y", "h"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Fits on labelled rows outside the held-out fifth; labels other than 0 and 1 and null ids are ignored.

    Null and empty texts are rows with the constant feature only; texts count whole, however long.  Of several labels of one doc_id the
    least counts, of several texts of one doc_id the one with the greatest hash, of equal ones either.  Other columns are ignored.
    Without labels (or with fewer than four of a class) the model gives their smoothed share, 0.5 for none, to every text.
    """
    try:
        return fit(*_fitting_rows(docs, labels, fit_rows))
    finally:
        give_back()  # the driver keeps the model only


def _fitting_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    seen = labels.where("doc_id is not null and quality in (0, 1)").where(crc_mod(F.col("doc_id"), 5) != 0)
    sample = seen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    picked = docs.sparkSession.createDataFrame(sample.toPandas(), "doc_id long, quality int")  # fit_rows rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    got = rows.select("doc_id", "text", F.col("quality").cast("int").alias("y"), F.xxhash64("text").alias("h")).mapInArrow(tidy(_extract), "doc_id long, keys array<int>, y int, h long")
    got = got.groupBy("doc_id").agg(F.max_by(F.struct("keys", "y"), "h").alias("x")).select("doc_id", "x.*").toArrow().sort_by("doc_id")
    keys = got["keys"].combine_chunks()
    flat, at = keys.flatten().to_numpy(), np.concatenate([[0], np.cumsum(keys.value_lengths())])
    return [flat[a:b] for a, b in zip(at, at[1:])], np.where(got["y"].to_numpy() == 1, 1, -1)  # noqa: B905


def _scores(column: pa.Array, m: dict) -> np.ndarray:
    out = [_margin(rows, keys, j - i, m["r"], m["w"]) for i, j, rows, keys in features(column)]
    return 1 / (1 + np.exp(-np.clip(m["a"] * np.concatenate(out or [np.zeros(0)]) + m["b"], -500, 500)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, from its text alone.

    A null text counts as an empty one, which has the constant feature only.  Repeated rows get repeated results, a
    null doc_id stays null (and counts as held out by the crc32 of empty text, 0), other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 2**BITS numbers

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), held.value))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least the threshold; nothing is shuffled.

    Null and empty texts have the score of the constant feature and are kept or not by it; repeated rows and null ids are treated
    like any other, whole texts are scored, an empty table stays empty, and no name of a further column clashes.
    """
    arrow_batches(docs.sparkSession)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), held.value) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)

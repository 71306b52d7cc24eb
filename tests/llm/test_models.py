"""Tokens, the language model and chat windows: round trips, brute force and edge cases."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import regex
import tiktoken

from docsearch.llm import blocks, bpe, chat, hmm
from docsearch.llm.queries import tokenizer
from pyspark.sql import functions as F

TEXTS = [None, "", " ", "Hello world's end", "  two  spaces\n\n\tand tabs ", "naïve Ünïcode 漢字 😀 é", "a" * 5000, " \n" * 700, "12345 $%^ don't I'LL", "\u0000 x<|endoftext|>"]


def test_bpe(spark):
    ranks, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [(k, t, k) for k, t in enumerate(TEXTS)] + [(None, "null id", 0), (3, TEXTS[3], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int").repartition(3)
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/bpe-in")
    coded = bpe.encode(spark.read.parquet(path), ranks, pattern)
    both = bpe.decode(coded, ranks).collect()
    text = dict(enumerate(TEXTS)) | {None: "null id"}
    assert sorted(str(r.doc_id) for r in both) == sorted(str(r[0]) for r in rows)
    for r in both:
        assert r.ids == library.encode_ordinary(text[r.doc_id] or "")
        assert bytes(r.decoded) == (text[r.doc_id] or "").encode()
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), ranks, pattern).count() == 0


def plain_bpe(piece, ranks):
    """Byte pairs merged one by one, the least rank first, the leftmost of equal ones."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1 and (best := min((ranks.get(a + b, math.inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))[0] < math.inf:
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[x] for x in parts]


def test_bpe_is_that_of_brute_force(spark):
    ranks, pattern = tokenizer()
    rows = [(k, t) for k, t in enumerate(TEXTS) if len(t or "") < 3000]
    got = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, check int, part int"), ranks, pattern).collect()}
    assert got == {k: [i for x in regex.findall(pattern, t or "") for i in plain_bpe(x.encode(), ranks)] for k, t in rows}


def test_a_changed_word_list_is_an_error():
    a, b = (blocks.Block(0, [1], [2], np.array([0, 1]), w, []) for w in ([b"x", b"y"], [b"y", b"x"]))
    for parts in (1, 3):
        assert sum(c for *_, c, _ in a.bundles(parts)) % (1 << 64) == a.checksum() % (1 << 64)
    assert a.checksum() != b.checksum()


def test_bpe_of_documents(spark):
    ranks, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library.encode_ordinary(r.text) for r in docs.collect()}
    assert {r.doc_id: r.ids for r in bpe.encode(docs, ranks, pattern).collect()} == want


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    k, s = hmm.FIRST + hmm.CLASSES, hmm.STATES
    emit = rng.random((k, s))
    move, start = rng.random((s, s)), rng.random(s)
    m = {"emit": emit / emit.sum(0), "move": move / move.sum(1, keepdims=True), "start": start / start.sum(), "middle": start / start.sum()}
    sizes = np.array([3, 1, 700, 8])
    cls = rng.integers(0, k, sizes.sum())
    got, at = hmm.forward(cls, sizes, m), 0
    for x, n in zip(got, sizes, strict=True):
        seq, a, total = cls[at : at + n], None, 0.0
        for c in seq:
            a = (m["start"] if a is None else a @ m["move"]) * m["emit"][c]
            total += math.log10(a.sum())
            a = a / a.sum()
        at += n
        assert abs(x - total) < 1e-9 * max(1, abs(total))


def plain_expect(cls, sizes, m):
    """Baum-Welch counts, text by text."""
    counts, at = hmm.fresh_counts(), 0
    for n in sizes.tolist():
        seq, at = cls[at : at + n], at + n
        b = m["emit"][seq]
        a, c, back = np.zeros((n, hmm.STATES)), np.zeros(n), np.ones((n, hmm.STATES))
        for t in range(n):
            x = (a[t - 1] @ m["move"] if t else m["start"]) * b[t]
            c[t] = x.sum()
            a[t] = x / c[t]
        for t in range(n - 2, -1, -1):
            back[t] = m["move"] @ (b[t + 1] * back[t + 1]) / c[t + 1]
            counts["move"] += np.outer(a[t], b[t + 1] * back[t + 1] / c[t + 1]) * m["move"]
        np.add.at(counts["emit"], seq, a * back)
        counts["start"] += a[0] * back[0]
        counts["loglik"] += np.log10(c).sum()
    return counts


def test_expected_counts_are_exact_across_segments():
    rng = np.random.default_rng(5)
    k, s, g = hmm.FIRST + hmm.CLASSES, hmm.STATES, hmm.SEGMENT
    sizes = np.array([3, 2 * g + 17, 1, g, g + 1, 700, 8, 5 * g, 3 * g - 1, *rng.integers(1, 90, 40)])
    share = rng.random(k)
    m = hmm.first_model(share / share.sum())
    m["move"] = rng.random((s, s)) + np.eye(s)
    m["move"] /= m["move"].sum(1, keepdims=True)
    cls = rng.integers(0, k, sizes.sum())
    want, got = plain_expect(cls, sizes, m), hmm.fresh_counts()
    ends = np.cumsum(sizes)
    rows = ((np.zeros(j - i, bool), sizes[i:j], cls[(ends - sizes)[i] : ends[j - 1]]) for i, j in ((0, 5), (5, 20), (20, len(sizes))))
    hmm._gathered(rows, m, got)
    assert np.allclose(got["move"], want["move"], rtol=2e-3, atol=1e-2) and np.allclose(got["start"], want["start"], rtol=2e-3, atol=1e-3)
    assert np.allclose(got["emit"], want["emit"], rtol=5e-3, atol=1e-4) and abs(got["loglik"] - want["loglik"]) < 1e-4 * abs(want["loglik"])


def plain_scores(rows):
    """Brute force of the whole operator: (doc_id, text) to log10 probability."""
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [hmm.words(t) for i, t in rows if not held(i)]
    counts = Counter(w for t in train for w in t)
    kind = lambda w: hmm.word_class(w) if counts[w] > 1 else hmm.RARE
    share, mass, once = np.zeros(hmm.FIRST + hmm.CLASSES), Counter(), sum(c == 1 for c in counts.values())
    for w, c in counts.items():
        share[kind(w)] += c
        mass[kind(w)] += c + 1
    share[hmm.END], share[hmm.RARE] = len(train), max(once, 1)
    share /= share.sum()
    m = hmm.first_model(share)
    seqs = [[*map(kind, t), hmm.END] for t in train]
    for _ in range(hmm.ROUNDS):
        m = hmm.maximise(plain_expect(np.concatenate(seqs), np.array(list(map(len, seqs))), m), share)
    out = {}
    for i, t in rows:
        total, a = 0.0, m["start"]
        for k, w in enumerate([*hmm.words(t), None]):
            c = hmm.END if w is None else kind(w)
            within = 1 if w is None else (counts[w] + 1) / mass[c] if c != hmm.RARE else 0.5 / once if counts[w] else 0.5
            a = (a @ m["move"] if k else a) * m["emit"][c] * within
            total += math.log10(a.sum())
            a = a / a.sum()
        out[i] = total
    return out


def test_scores_are_those_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").select("doc_id", "text").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900001, " ".join(f"w{k % 50}" for k in range(2500))), (900002, "")]
    want = plain_scores(rows)
    got = {r.doc_id: r.score for r in hmm.score(spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, score double, block int").repartition(3)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-3 * abs(want[i]) + 1e-6 for i in want)


def test_baum_welch_climbs():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 60)
    cls = np.concatenate([np.append(rng.integers(2 + 50 * (k % 2), 52 + 50 * (k % 2), n - 1), 0) for k, n in enumerate(sizes)])
    share = np.bincount(cls, minlength=hmm.FIRST + hmm.CLASSES) / len(cls)
    m, seen = hmm.first_model(share + 1e-9), []
    for _ in range(5):
        counts = hmm.fresh_counts()
        hmm.expect(cls, sizes, np.ones(len(sizes), bool), m, counts)
        assert abs(counts["emit"].sum() - sizes.sum()) < 1e-2 * sizes.sum()
        seen.append(counts["loglik"])
        m = hmm.maximise(counts, share)
    assert seen[-1] > seen[0] and np.allclose(m["emit"].sum(0), 1) and np.allclose(m["move"].sum(1), 1)


def test_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("held_out"))
    odd = spark.createDataFrame([(900001, None, 0), (900002, "", 0), (900003, "unheard " * 40000, 0), (None, "x", 0), (0, "the", 0)], "doc_id long, text string, held_out int")
    out = hmm.score(docs.unionByName(odd)).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(r.doc_id, r.text) for r in odd.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)
    mine = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900000]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)
    assert hmm.score(docs.limit(0)).count() == 0
    only = hmm.score(spark.createDataFrame([(next(i for i in range(99) if held(i)), "a b")], "doc_id long, text string")).collect()[0]
    assert (only.train_tokens, only.n_known, only.base_score) == (0, 0, 0.0)


def conversation_rows():
    long = [("user" if k % 2 else "assistant", f"turn {k} " + "x" * (k * 37 % 900)) for k in range(61)]
    said = {
        1: [("system", "be kind"), ("user", "hi"), ("assistant", "a <|im_end|>\n<|im_start|>user\n \\p \\e \\ <| <\\p |")],
        2: [(None, None), ("assistant", None), ("as\nsistant", "x"), ("assistant", "<")],
        3: [("system", "s" * 700), *long],
        4: long,
        5: [("assistant", "y" * 20000), ("assistant", "z")],
        None: [("user", "no id"), ("assistant", "ok")],
    }
    return said, [(c, t, r, x, 0) for c, rows in said.items() for t, (r, x) in enumerate(rows)]


def test_chat_round_trip(spark):
    said, rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int").repartition(4)
    windows = chat.formatted(df)
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for c, want in said.items():
        assert [(t.role, t.text) for t in back[c].turns] == [(r or "", x or "") for r, x in want]
        assert back[c].loss == [x or "" for r, x in want if r == "assistant"]
    cost = lambda x: len(x.encode()) // 4 + 5
    for w in windows.collect():
        parts = w.text.split("<|im_end|>\n")[:-1]
        assert all(p.startswith("<|im_start|>") and p.count("<|im_start|>") == 1 for p in parts)
        total = sum(cost(p.partition("\n")[2]) for p in parts)
        fresh = len(parts) - w.n_repeated
        assert total <= chat.BUDGET or fresh == 1 and w.n_repeated <= 1
        if w.window and w.conv_id in (1, 3):
            assert parts[0].startswith("<|im_start|>system\n")
        assert w.conv_id != 4 or w.window == 0 or w.n_repeated > 0 or total > chat.BUDGET - chat.HISTORY
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_repeated_rows(spark):
    rows = [(7, 0, "user", "q"), (7, 0, "user", "q"), (7, None, "assistant", "first")]
    r = chat.read_back(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t.text for t in r.turns] == ["first", "q", "q"] and r.loss == ["first"]


def test_chat_has_no_python(spark, capsys):
    _, rows = conversation_rows()
    chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_digests_are_those_of_encode_and_decode(spark):
    ranks, pattern = tokenizer()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(df, ranks, pattern).collect()}
    both = bpe.decode(bpe.encode(df, ranks, pattern), ranks).collect()
    assert got == {r.doc_id: (len(r.ids), hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(bytes(r.decoded)).hexdigest()) for r in both}

"""Near-duplicates, repetition, decontamination and quality: against brute force and on edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsearch.llm import decontam, neardup, quality, repeats, textkit
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "a", "one two three four", "x " * 30000, "é ß　x y", "A B C D E F", "a b c d e f"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def grams(t):
    w = WORD.findall(lower(t))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    """Brute force: (doc_id, set size, component) of (doc_id, text)."""
    sets = [grams(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def near_texts(n=400, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(3000)]
    out = []
    for family in range(12):
        base = [r.choice(words) for _ in range(r.randint(6, 150))]
        for _ in range(n // 12):
            copy = base.copy()
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = r.choice(words)
            if family % 3 == 0:
                copy += [r.choice(words) for _ in range(r.randint(0, len(base) // 4))]
            out.append(" ".join(copy))
    passage = " ".join(r.choice(words) for _ in range(60))
    return out + [passage + " " + " ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(60)] + ODD


def test_near_duplicates(spark):
    rows = list(enumerate(near_texts()))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, sig string, cid long")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in classes(rows).items()}


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (4, None)]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, None, True), (3, 3, 1, False), (4, 0, 4, True)], key=str)
    kept = neardup.representatives(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 1, None, 4], key=str)


def test_near_duplicates_of_repeated_ids(spark):
    one, other = (" ".join(f"{x}{k}" for k in range(40)) for x in "xy")
    rows = [(5, one), (5, other), (7, one), (6, other), (9, other + " z"), (8, "alone")]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], "doc_id long, text string, dropped int, row int, cid int, component int")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {(5, 36): (5, True), (7, 36): (5, False), (6, 36): (5, False), (9, 37): (5, False), (8, 1): (8, True)}
    kept = neardup.representatives(df)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 5, 8] and kept.columns == df.columns


def test_a_passage_in_thousands_of_texts(spark, monkeypatch):
    """5,000 texts with one passage in common, just under the similarity, and a few that are over it: all are told apart."""
    r = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(k, passage + " " + " ".join(f"{k}x{j}" for j in range(8 + k % 12))) for k in range(5000)]
    pairs = [(k, passage + " " + " ".join(f"{k}y{j}" for j in range(30))) for k in range(6000, 6010)]
    rows += pairs + [(k + 100, t + f" tail{k}") for k, t in pairs]
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sizes = {i: len(grams(t)) for i, t in rows}
    # the passage has 66 shingles: short texts are linked by it alone, the longest with the shortest
    link = lambda a, b: 100 * 66 >= 75 * (sizes[a] + sizes[b] - 66)
    least = min(i for i in range(5000) if link(i, min(range(5000), key=sizes.get)))
    shortest = min(sizes[i] for i in range(5000))
    for i in range(5000):
        assert got[i] == (least if 100 * 66 >= 75 * (sizes[i] + shortest - 66) else i)
    for k in range(6000, 6010):
        assert got[k] == got[k + 100] == k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB é \n\t.", max_size=60) | st.none(), max_size=6))
def test_shingles_of_any_text(texts):
    got = []
    for _, _, h, off in textkit.shingle_sets(pa.array(texts, pa.string())):
        got += [off[k + 1] - off[k] for k in range(len(off) - 1)]
    assert got == [len(grams(t)) for t in texts]


def repetition(t, least=repeats.MIN_REPEAT):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    rep = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    long = Counter(tuple(w[k : k + least]) for k in range(len(w) - least + 1))
    cov = {k + j for k in range(len(w) - least + 1) if long[tuple(w[k : k + least])] > 1 for j in range(least)}
    best = next((n for n in range(len(w) - 1, 0, -1) if max(Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)).values()) > 1), 0)
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep), len(cov), best, failed


def test_repetition(spark):
    r = random.Random(2)
    some = [" ".join(r.choices("abcdefghijklmnopqrst", k=r.randint(1, 120))) for _ in range(60)]
    some += ["\n".join(r.choices([f"line {k} of text #{k}" for k in range(9)], k=30)) for _ in range(10)]
    p = " ".join(f"w{k}" for k in range(40))
    some += [f"{p} {p}", p + " " + " ".join(f"v{k}" for k in range(300)) + " " + p, *[t for t in ODD if t is None or len(t) < 500]]
    rows = [(k, t, 1) for k, t in enumerate(some)]
    out = repeats.repetition(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    for x in out:
        want = repetition(some[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.covered_words, x.longest_repeat, x.base_failed) == want
        assert x.kept == (not want[7] and want[5] <= repeats.MOST_COVERED * want[0] and want[6] <= repeats.LONGEST)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repetition(empty).count() == repeats.accepted(empty).count() == 0
    huge = repeats.repetition(spark.createDataFrame([(1, "x " * 200000), (None, None)], "doc_id long, text string")).orderBy("n_words").collect()
    assert (huge[1].longest_repeat, huge[1].kept, huge[0].n_words) == (199999, False, 0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=4))
def test_suffix_array(texts):
    rows = np.array([k for k, t in enumerate(texts) for _ in t], np.int64)
    flat = [x for t in texts for x in t]
    words = textkit.mix(np.array(flat, np.uint64))
    ends = [sum(map(len, texts[: r + 1])) for r in rows]
    if flat:
        sa, lcp = repeats.suffix_lcp(rows, words)
        common = lambda i, j: next((k for k in range(ends[i] - max(i, j)) if flat[i + k] != flat[j + k]), ends[i] - max(i, j)) if rows[i] == rows[j] else 0
        assert sorted(sa) == list(range(len(flat))) and lcp.tolist() == [0] + [common(sa[k - 1], sa[k]) for k in range(1, len(sa))]
        for i in range(len(flat)):  # every suffix stands beside the one it shares most with
            best = max((common(i, j) for j in range(len(flat)) if j != i), default=0)
            k = sa.tolist().index(i)
            assert max(lcp[k], lcp[k + 1] if k + 1 < len(sa) else 0) == best


ITEM = "A train travels from Boston at 60 km per hour and meets Alice after 5 hours while Alice waits near the old stone bridge for her friend"


def test_decontamination(spark):
    other = "In this text nobody travels and nothing happens at all which is why it is clean and stays as it was before today"
    docs = [
        (1, f"Some words before. {ITEM}. And some after it."),
        (2, "Intro here. " + ITEM.replace("60", "75").replace("5 hours", "9 hours").replace("Alice", "Betty")),
        (3, "Intro here. " + ITEM.replace("Alice after", "Betty after")),
        (4, other),
        (5, None),
        (6, ITEM.upper()),
        (7, " ".join(ITEM.split()[:6])),
        (None, ITEM),
        (1, f"Some words before. {ITEM}. And some after it."),
        (8, "short item here"),
    ]
    bench = [(0, ITEM), (1, "Short item here!"), (2, None), (3, ""), (None, ITEM), (4, "60 60 60 60 60 60 60 60 60")]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots for r in decontam.leaks(d, b).collect()}
    assert got.keys() == {(1, 0), (2, 0), (6, 0), (8, 1)}
    assert got[1, 0] == 0 and got[2, 0] == 3
    assert sorted((r.doc_id for r in decontam.decontaminate(d, b).collect()), key=str) == sorted([3, 4, 5, 7, None], key=str)
    clash = d.withColumn("leaked", F.lit(1)).withColumn("code", F.lit(2))
    assert decontam.decontaminate(clash, b).columns == clash.columns and decontam.decontaminate(clash, b).count() == 5
    assert decontam.leaks(d.limit(0), b).count() == decontam.leaks(d, b.limit(0)).count() == 0


def test_leaks_are_those_of_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in (r.text or "")}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == want


def plain_quality(texts, y):
    """Brute force of the operator on features given as sets: ratios, a primal solver of the same problem, margins of one fold."""
    n = 1 + max(x for t in texts for x in t)
    p, q = np.full(1 << quality.BITS, quality.ALPHA), np.full(1 << quality.BITS, quality.ALPHA)
    for t, c in zip(texts, y, strict=True):
        (p if c > 0 else q)[list(t)] += 1
    r = (np.log(p / p.sum()) - np.log(q / q.sum()))[:n]
    r[0] = 1.0
    x = np.zeros((len(texts), n))
    for k, t in enumerate(texts):
        x[k, list(t)] = r[list(t)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cost = np.where(y > 0, quality.C * len(y) / (2 * (y > 0).sum()), quality.C * len(y) / (2 * (y < 0).sum()))
    w, best, seen = np.zeros(n), np.zeros(n), np.inf
    for step in range(1, 40001):  # subgradients of |w|^2 / 2 + sum of cost * hinge
        inside = y * (x @ w) < 1
        w = w - (w - (cost * inside * y) @ x) / (step + 50)
        loss = w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
        if loss < seen:
            best, seen = w.copy(), loss
    return r, best, seen, x, cost


def test_dual_coordinate_descent_solves_its_problem():
    rng = np.random.default_rng(2)
    texts, y = [], np.array([1] * 20 + [-1] * 15)
    for c in y:
        texts.append({0, *(int(k) for k in np.flatnonzero(rng.random(12) < np.where(np.arange(12) % 2 == (c > 0), 0.6, 0.25)) + 1)})
    rows = [np.array(sorted(t)) for t in texts]
    r, want, loss, x, cost = plain_quality(texts, y)
    assert np.allclose(quality._ratios(rows, y)[: len(r)], r)
    got = quality._descend(rows, y, quality._ratios(rows, y), cost)[: len(r)]
    mine = got @ got / 2 + (cost * np.maximum(0, 1 - y * (x @ got))).sum()
    assert mine <= loss * 1.02 and np.allclose(got, want, atol=0.15 * np.abs(want).max())


def test_quality_of_repeated_ids(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" more")))).withColumns({"keys": F.lit(1), "y": F.lit(2), "h": F.lit(3), "quality": F.lit(9)})
    m = [quality.train(x, labels) for x in (twice.repartition(3), twice.repartition(7))]
    assert np.array_equal(m[0]["w"], m[1]["w"]) and quality.accepted(twice, m[0]).columns == twice.columns


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out) and len(out) > 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(None, "x"), (1, "x")], "doc_id long, text string")
    for marks in (labels, labels.limit(0), labels.where("quality = 1")):
        m = quality.train(docs, marks)
        scored = quality.score(odd, m).collect()
        assert len(scored) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in scored)
    assert quality.accepted(odd, m).columns == odd.columns
    assert quality.score(odd.limit(0), m).count() == 0


@pytest.mark.parametrize("text", ODD)
def test_templates_of_odd_texts(text):
    raw, off = textkit.buffers(pa.array([text], pa.string()))
    out = list(decontam.windows(raw, off, 0, 1, None))
    assert all(len(w[3]) == len(w[4]) <= decontam.WINDOW for w in out)


def test_dense_items_are_found(spark):
    dense = "12 apples 7 pears 3 plums 9 figs 14 nuts 6 limes 8 dates"
    table = "17 23 31 48 5 66 72 81 9 104 11 128"
    docs = [(1, f"Before it came this: {dense} and after it nothing."), (2, "So " + dense.replace("12", "15").replace("9 figs", "2 figs") + " it is."), (3, f"The table: {table} ends."), (4, "The table: " + table.replace("48", "47").replace("9 104", "8 103") + " ends."), (5, "1 apple")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(0, dense), (1, table)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.changed_slots) for r in decontam.leaks(d, b).collect()}
    assert got.keys() == {(1, 0), (2, 0), (3, 1)}
    assert got[1, 0] == got[3, 1] == (1.0, 0) and got[2, 0][1] == 2


def plain_leaks(docs, items):
    """Brute force over all alignments, for items of eight words and more without runs of slots or names at sentence starts."""

    def parts(t):
        words, out = (t or "").split(), []
        for k, w in enumerate(words):
            x = w.strip(".,?!")
            kind = "number" if x.isdigit() else "unit" if k and words[k - 1].isdigit() and x in decontam.UNITS else "name" if k and words[k - 1][-1] not in ".?!" and x[0].isupper() and x[1:].islower() and x[1:] else ""
            out.append((kind, x.lower()))
        return out

    found = {}
    for i, t in docs:
        d = parts(t)
        for j, item in items:
            b, covered, changed = parts(item), set(), []
            for shift in range(-len(b), len(d)):
                same = {}
                for masked in (True, False):
                    form = lambda x, masked=masked: x[0] if x[0] and (masked or x[0] != "name") else x[1]
                    for p in range(len(b) - 7):
                        if 0 <= p + shift and p + shift + 8 <= len(d) and all(form(b[p + k]) == form(d[p + shift + k]) for k in range(8)) and sum(form(b[p + k]) == b[p + k][1] and not (b[p + k][0]) for k in range(8)) + (0 if masked else sum(b[p + k][0] == "name" for k in range(8))) >= 5:
                            same |= dict.fromkeys(range(p, p + 8))
                votes = {}
                for p in same:
                    (kind, a), x = b[p], d[p + shift][1]
                    if kind == "name":
                        votes.setdefault("back", []).append((x, a))
                    if kind:
                        votes.setdefault(kind, []).append(((a, b[p + 1][1] if p + 1 < len(b) else "") if kind == "number" else a, x))
                if same and all(3 * sum(max(Counter(y for k2, y in v if k2 == key).values()) for key in {k2 for k2, _ in v}) > 2 * len(v) for v in votes.values()):
                    covered |= same.keys()
                    changed.append(len({(b[p][1], d[p + shift][1]) for p in same if b[p][1] != d[p + shift][1]}))
            if 2 * len(covered) >= len(b):
                found[i, j] = len(covered), min(changed)
    return found


def test_templates_are_those_of_brute_force(spark):
    r = random.Random(4)
    fill = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were".split()
    nouns = "apples pears plums boats cards coins books lamps".split()
    names = "Anna Boris Clara David Emma Felix".split()
    items, docs = [], []

    def item():
        n = r.randint(3, 6)
        return " ".join(f"{' '.join(r.choices(fill, k=r.randint(5, 8)))} {r.choice(names)} has {r.randint(2, 9)} {r.choice([*nouns, 'km', 'minutes'])}" for _ in range(n))

    for j in range(12):
        items.append((j, "so " + item()))
    for j, t in items:
        for _ in range(5):
            w = t.split()
            for k in range(len(w)):
                if w[k].isdigit() and r.random() < 0.5:
                    w[k] = str(r.randint(2, 30))
                if w[k] in names and r.random() < 0.15:
                    w[k] = r.choice(names)
                if w[k] in fill and r.random() < 0.03:
                    w[k] = "other"
            docs.append((len(docs), " ".join(r.choices(fill, k=20)) + " " + " ".join(w) + " " + " ".join(r.choices(fill, k=20))))
        docs.append((len(docs), "so " + item()))
    d = spark.createDataFrame([(*x, 0, "t") for x in docs], "doc_id long, text string, shift int, type string")
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id): (x.covered, x.changed_slots) for x in decontam.leaks(d, b).collect()}
    want = plain_leaks(docs, items)
    assert got == want and len(want) > 20


def test_equal_parameters_may_part(spark):
    item = "A car drives for 60 minutes at a speed of 60 km an hour and then it stops near 3 apples and 3 pears"
    docs = [(1, "Now this. " + item.replace("60 minutes", "75 minutes").replace("60 km", "90 km")), (2, "Now this. " + item.replace("3 apples", "5 apples").replace("3 pears", "7 pears")), (3, "Now that is not it at all, for a car that drives")]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.changed_slots) for r in got} == {(1, 2), (2, 2)}
    sums = "2 + 2 = 4, 3 + 3 = 6, 4 + 4 = 8, 5 + 5 = 10"
    docs = [(1, f"Learn this: {sums}, and more."), (2, "Learn this: 2 + 3 = 5, 3 + 4 = 7, and more.")]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, sums), (1, "who wrote it first")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 0)]


def test_short_items_inside_documents(spark):
    bench = [(0, "who wrote the first long novel"), (1, "12 or 15 pears?"), (2, "今天天气很好我们去公园散步吧"), (3, "什么是爱"), (4, "what is the capital of France"), (5, "Zugzwang")]
    docs = [
        (1, "They asked: Who wrote the first long novel? Nobody in the room knew the answer at all."),
        (2, "And then he said 12 or 15 pears, which was not so many as we all had thought."),
        (3, "And then he said 13 or 15 pears, which was not so many as we all had thought."),
        (4, "他说：“今天天气很好，我们去公园散步吧。”然后他们就出发了。"),
        (5, "有人问：什么是爱？没有人回答这个问题。"),
        (6, "We wondered what is the capital of Poland and of the other lands near it."),
        (7, "In chess a zugzwang, and then again a Zugzwang, is a thing that players like to see."),
        (8, "他们没有说什么，也没有去公园，大家都在家里看书。"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.changed_slots) for r in decontam.leaks(d, b).collect()}
    assert got == {(1, 0): (1.0, 0), (2, 1): (1.0, 0), (4, 2): (1.0, 0), (5, 3): (1.0, 0), (6, 4): (1.0, 1), (7, 5): (1.0, 0)}

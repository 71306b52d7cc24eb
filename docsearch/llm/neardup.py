"""MinHash near-duplicates by an inverted join on signature coordinates.

Every text becomes its set of distinct 5-word shingles.  Texts with equal sets form one class.  A class has a
signature of ``COORDS`` minima; it is posted under its (coordinate, value) pairs.  Two sets with a similarity of
0.75 agree in 48 +- 3.5 of 64 coordinates; ``MATCHES`` = 32 lies 4.6 standard deviations below, and a pair with so
many matches must share a posting among the rarest of each, if each leaves out its ``MATCHES`` - 1 most frequent ones
(prefix).  Pairs that one class alone has are no postings at all, and a class with fewer than ``MATCHES`` shared ones has no
partner (skip merging); nor have classes that are in one component already, or whose set sizes differ too much.

For each pair that a posting list brings together the colliding coordinates of the two signatures are counted, and pairs
with ``MATCHES`` or more are confirmed on the full sets.  Within a list, classes are first paired with one pivot each (two
rounds, with other pivots) and merged into components; only lists that then still hold several components are counted
exhaustively, signatures only, in blocks of 1024 x 1024.  Full sets go to those that such a count leaves undecided, once for each
block pair (one whose sets are too large together is cut), and only links leave it.  So no list is expanded into pairs, nothing is
capped, and a hot list is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.llm import textkit
from docsearch.llm.blocks import ragged
from docsearch.llm.common import arrow_batches, components, give_back, materialise, release, small, tidy, without

SHINGLE, COORDS, MATCHES, BLOCK, SUB_SHINGLES = 5, 64, 32, 1024, 1 << 19
_MULT = np.random.default_rng(64).integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minima(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), COORDS), np.int32)
    for k in range(COORDS):
        x = h * _MULT[k]
        x ^= x >> np.uint64(29)
        out[:, k] = (np.minimum.reduceat(x, starts) >> np.uint64(20)).astype(np.uint32).view(np.int32)
    return out


def _keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(size, two sums of hashes) of each set."""
    size = np.diff(off)
    a = np.zeros((3, len(size)), np.uint64)
    a[0] = size
    if some := len(at := np.flatnonzero(size)):
        for k in (1, 2):
            a[k, at] = np.add.reduceat(textkit.mix(h, k), off[at])
    return a.view(np.int64) if some else a.astype(np.int64)


def _signatures(shingle: int):
    def run(batches):
        for batch in batches:
            sig, keys = [], []
            for _, _, h, off in textkit.shingle_sets(batch.column(1), shingle):
                some = np.flatnonzero(np.diff(off))
                rows = _minima(h, off[some]) if len(some) else np.zeros((0, COORDS), np.int32)
                at = np.concatenate([[0], np.cumsum(np.where(np.diff(off) > 0, COORDS, 0))]).astype(np.int32)
                sig.append(pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel())))
                keys.append(_keys(h, off))
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.concatenate(keys, axis=1)), pa.concat_arrays(sig)], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return run


def _sets(shingle: int):
    """Full shingle sets as sorted little-endian 64-bit numbers, of the texts that have the class's keys."""

    def run(batches):
        for batch in batches:
            want = np.stack([batch.column(k).to_numpy() for k in (2, 3, 4)])
            for i, j, h, off in textkit.shingle_sets(batch.column(1), shingle):
                own = np.flatnonzero((_keys(h, off) == want[:, i:j]).all(0))
                sets = [h[off[r] : off[r + 1]].tobytes() for r in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + own)), pa.array(sets, pa.binary())], ["cid", "grams"])

    return run


def _linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _confirm(percent: int):
    """Of (ca, cb, a, ga, gb), in runs of equal a, the (ca, cb) whose full sets are linked."""

    def run(batches):
        for batch in batches:
            keep, mine, last = [], np.zeros(0, np.uint64), None
            for a, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if a != last:
                    mine, last = np.frombuffer(x.as_buffer(), np.uint64), a
                other = np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(_linked(len(np.intersect1d(mine, other, assume_unique=True)), len(mine), len(other), percent)))
            t = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if t.num_rows:
                yield t

    return run


def _collide(percent: int):
    """Counts colliding coordinates between the two sides of a block pair, and deals what may be linked to sub-blocks.

    A row for each class of a sub-block with such a partner; those of the left side carry their partners.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid")
        token, bi, bj = (t[c][0].as_py() for c in ("token", "bi", "bj"))
        cid, comp, block, size = (t[c].to_numpy() for c in ("cid", "comp", "block", "n_shingles"))
        sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDS)
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        one, other = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for x, i in enumerate(left.tolist()):
            js = right[x + 1 :] if bi == bj else right
            js = js[(comp[js] != comp[i]) & (100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i]))]
            js = js[(sig[js] == sig[i]).sum(1) >= MATCHES]
            one.append(np.full(len(js), i, np.int32))
            other.append(js.astype(np.int32))
        one, other = np.concatenate(one), np.concatenate(other)
        # parts of either side of so many shingles together
        part = np.zeros(len(cid), np.int32)
        for side in (left, right):
            part[side] = np.cumsum(size[side]) // SUB_SHINGLES
        out = []
        place = part[one].astype(np.int64) << 32 | part[other]
        for p in np.unique(place).tolist():
            a, b = one[place == p], other[place == p]
            inside = np.unique(np.concatenate([a, b]))
            ends = np.searchsorted(a, inside, "right")  # the left side is in order
            at = np.concatenate([[0], ends]).astype(np.int32)
            kinds = {"token": (token, pa.int64()), "bi": (bi, pa.int32()), "bj": (bj, pa.int32()), "x": (p >> 32, pa.int32()), "y": (p & 0xFFFFFFFF, pa.int32())}
            fixed = [pa.repeat(pa.scalar(v, k), len(inside)) for v, k in kinds.values()]
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(cid[b]))
            out.append(pa.table([*fixed, pa.array(cid[inside]), pa.array(comp[inside]), lists], [*kinds, "cid", "comp", "partners"]))
        empty = [("token", pa.int64()), *((c, pa.int32()) for c in ("bi", "bj", "x", "y")), ("cid", pa.int64()), ("comp", pa.int64()), ("partners", pa.list_(pa.int64()))]
        return pa.concat_tables(out) if out else pa.schema(empty).empty_table()

    return run, "token long, bi int, bj int, x int, y int, cid long, comp long, partners array<long>"


def _decide(percent: int):
    """Links of different components within a sub-block, on the full sets; none between what others have joined already."""

    def run(t: pa.Table) -> pa.Table:
        give_back()  # what the sub-block before has left
        t = t.sort_by("cid")
        cid, comp = t["cid"].to_numpy(), t["comp"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["grams"]]
        size = np.array([len(x) for x in sets])
        offsets = np.concatenate([[0], np.cumsum(size)])
        distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
        lists = t["partners"].combine_chunks()
        js = np.searchsorted(cid, lists.flatten().to_numpy())
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        mark, label, links = np.zeros(len(distinct), bool), comp.copy(), []
        for i in np.flatnonzero(np.diff(ends)).tolist():
            j = js[ends[i] : ends[i + 1]]
            j = j[label[j] != label[i]]
            if not len(j):
                continue
            mine = codes[offsets[i] : offsets[i + 1]]
            mark[mine] = True
            theirs, _ = ragged(codes, offsets, j)
            both = np.add.reduceat(mark[theirs], np.cumsum(size[j]) - size[j], dtype=np.int64)
            mark[mine] = False
            for k in np.unique(label[j[_linked(both, size[i], size[j], percent)]]).tolist():
                links.append((int(label[i]), k))
                label[label == k] = label[i]
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["ca", "cb"])

    return run


def _merge(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Lists with their classes' components merged along the links."""
    roots = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return lists.join(roots.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked when 100 * |A n B| >= percent * |A u B| for their shingle sets; ``component_id`` is the
    smallest doc_id reachable, ``kept`` tells whether that is the document itself.  A text with fewer words than a
    shingle is one shingle; null, empty and blank texts have none and are linked with nothing.  Rows that share a
    doc_id are one document: each gets a row, and the links of all their texts count.  A null doc_id is linked with nothing: its component_id is null and it is kept.  An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    p1 = src.mapInArrow(tidy(_signatures(shingle)), "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>")
    p1 = materialise(p1.withColumn("row", F.monotonically_increasing_id()), "signatures")
    keyed = p1.where("n_shingles > 0 and doc_id is not null")
    # classes of several rows; a table of its own, so that both sides of the join are plain shuffles, which Spark splits where
    # one class has very many copies (so are the tables below that lists of any length are joined with)
    key = ["n_shingles", "k1", "k2"]
    classes = materialise(keyed.groupBy(*key).agg(F.min("row").alias("cid"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "classes")
    members = keyed.select("row", "doc_id", *key).join(classes, key, "left")
    members = materialise(members.select("row", "doc_id", F.coalesce("cid", "row").alias("cid")), "members")
    reps = keyed.join(small(members.where("row <> cid").select("row")), "row", "left_anti").withColumnRenamed("row", "cid")
    post = reps.select("cid", F.posexplode("sig").alias("pos", "value")).select("cid", F.xxhash64("pos", "value").alias("token"))
    shared = materialise(post.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    lists = (
        post.join(shared, "token")
        .groupBy("cid")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ts"))
        .where(F.size("ts") >= MATCHES)
        .select("cid", F.explode(F.slice("ts", F.lit(1), F.size("ts") - (MATCHES - 1))).alias("t"))
        .select(F.col("t.token").alias("token"), "cid", F.col("cid").alias("comp"))
    )
    lists = materialise(lists, "postings")
    release(classes, shared)
    wanted = reps.join(small(lists.select("cid").distinct()), "cid", "left_semi")
    wanted = materialise(wanted.select("cid", "doc_id", *key, "sig"), "candidates")
    source = src.join(small(wanted.select("doc_id", "cid", *key)), "doc_id").select("cid", "text", *key)
    sets = materialise(source.mapInArrow(tidy(_sets(shingle)), "cid long, grams binary").dropDuplicates(["cid"]), "sets")
    sig = wanted.select("cid", "n_shingles", "sig")

    # rows of one document belong together
    twice = members.groupBy("doc_id").agg(F.min("cid").alias("ca"), F.max("cid").alias("last")).where("ca < last").select("doc_id", "ca")
    edges = [members.join(small(twice), "doc_id").select("ca", F.col("cid").alias("cb"))]
    for turn in range(2):
        pivot = F.min(F.struct(F.xxhash64("cid", F.lit(turn)), "cid", "comp") if turn else F.struct("cid", "comp", F.lit(0))).alias("p")
        open_lists = lists.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), pivot).where("lo < hi")
        open_lists = materialise(open_lists.select("token", F.col("p.cid").alias("a"), F.col("p.comp").alias("ca")), f"pivots-{turn}")
        pairs = lists.join(open_lists, "token").where("ca <> comp").select("a", "ca", F.col("cid").alias("b"), F.col("comp").alias("cb")).distinct()
        a, b = (sig.select(F.col("cid").alias(x), F.col("sig").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "ab")
        collisions = F.size(F.filter(F.arrays_zip("sa", "sb"), lambda z: z["sa"] == z["sb"]))
        pairs = pairs.join(a, "a").join(b, "b").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (collisions >= MATCHES)).select("a", "b", "ca", "cb")
        pairs = materialise(pairs, f"star-{turn}")
        ga, gb = (sets.select(F.col("cid").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
        links = pairs.join(gb, "b").join(ga, "a").select("ca", "cb", "a", "ga", "gb").mapInArrow(tidy(_confirm(percent)), "ca long, cb long")
        links = materialise(links.distinct(), f"links-{turn}")
        edges.append(links)
        release(open_lists, pairs)
        before, lists = lists, materialise(_merge(lists, links), f"postings-{turn}")
        release(before)

    state = lists.groupBy("token").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("h")).where("lo < hi")
    state = state.groupBy("size", "h").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("nb"))
    left = lists.join(materialise(state, "open"), "token").join(sig, "cid").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    left = left.select("token", "cid", "comp", "n_shingles", "sig", "block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    left = left.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    near = materialise(left.groupBy("token", "bi", "bj").applyInArrow(*_collide(percent)), "undecided")
    found = near.join(sets, "cid").groupBy("token", "bi", "bj", "x", "y").applyInArrow(_decide(percent), "ca long, cb long")
    edges.append(materialise(found.distinct(), "links"))
    release(near, lists, sets, wanted)

    roots = components(reduce(DataFrame.unionAll, edges).select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b"))
    grouped = members.join(roots.select(F.col("node").alias("cid"), "component"), "cid", "left").select("row", "doc_id", F.coalesce("component", "cid").alias("component"))
    grouped = materialise(grouped, "grouped")
    least = materialise(grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    by_row = grouped.join(least, "component").select("row", "component_id")
    return (
        p1.select("row", "doc_id", "n_shingles")
        .join(by_row, "row", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def representatives(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, with all their columns, without those that ``near_duplicates`` does not keep."""
    dropped = materialise(near_duplicates(docs, percent=percent).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    return without(docs, dropped)

"""Benchmark decontamination by templates.

Tokens are words without surrounding punctuation, lower-cased A-Z.  Numbers, units after numbers and names (a
capital and a small letter, not at the start of a sentence) become typed placeholders; the words under them are
the slots.  Windows of eight template tokens, of which five are literal, are hash-joined with those of the benchmark;
a window with names is posted with and without the names replaced.  A window with fewer literals is widened until it has five,
and also posted as its eight words unmasked, which only a verbatim copy has; so every token lies in some window.  An item of fewer than eight tokens is one
window; documents post windows of the lengths that such items have, with five literals or else as their words unmasked, so an
item of one word leaks wherever the word stands.  Scripts without spaces count each character as a token.  A bit map of fixed size over the benchmark's
windows lets only likely windows of a document leave the scan.  Per document, item and alignment, the slots must be consistent: of the
slots of each type more than ``AGREE`` must have the value that is most frequent for their key.  A name's key is the name, in the item and, the
other way, in the document; a number's is the number with the word after it, as 60 km and 60 minutes are two parameters that happen to be equal;
a unit's is the unit.  The windows of consistent alignments then have to cover ``COVER`` of the item's tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.llm import textkit
from docsearch.llm.common import arrow_batches, materialise, small, tidy, without

WINDOW, LITERALS, COVER, MAP_BITS, AGREE = 8, 5, 0.5, 24, 2 / 3
#: Types of slots.
LITERAL, NUMBER, UNIT, NAME = range(4)
#: Units that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz pound pounds ounce ounces gram grams kilogram kilograms "
    "ton tons ml l litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "km/h mph kmh meter meters metre metres kilometer kilometers kilometre kilometres dollar dollars euro euros cent cents percent degree degrees "
    "joule joules watt watts volt volts amp amps newton newtons hz khz mhz ghz kb mb gb tb"
).split()
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0xA1, 0xB2, 0xC3))
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _hash_words(words: list[str]) -> np.ndarray:
    raw, off = textkit.buffers(pa.array(words))
    b, s, e, _ = textkit.spans(raw, off, 0, len(words))
    return textkit.word_hashes(b, s, e)


#: Characters of scripts without spaces, and of their punctuation, by the first two bytes: kana and ideographs, Thai, Lao, Myanmar, Khmer, full-width forms.
_UNSPACED = np.zeros(1 << 16, bool)
_UNSPACED[0xE380:0xEA00] = _UNSPACED[0xE0B8:0xE0BC] = _UNSPACED[0xE180:0xE183] = _UNSPACED[0xE19E:0xE1A0] = _UNSPACED[0xEFBC:0xEFBE] = _UNSPACED[0xF0A0:0xF0B4] = True
_STOPS = np.unique(_hash_words(list("\u3000、。〈〉《》「」『』【】〔〕〖〗・！＂＇（），－．／：；＜＝＞？［＼］｛｜｝～｡｢｣､･។៕၊။")))
_UNIT_HASHES = np.unique(_hash_words(UNITS))


def _characters(b: np.ndarray, s: np.ndarray, e: np.ndarray, rows: np.ndarray):
    """Words cut around each character of a script without spaces; the punctuation of these scripts is left out."""
    lead = np.flatnonzero(b[:-1] >= 0xE0)
    lead = lead[_UNSPACED[b[lead].astype(np.int64) << 8 | b[lead + 1]]]
    if not len(lead):
        return s, e, rows
    cuts = np.unique(np.concatenate([lead, lead + np.where(b[lead] >= 0xF0, 4, 3)]))
    word = np.searchsorted(s, cuts, "right") - 1
    cuts = cuts[(cuts > s[word]) & (cuts < e[word])]
    starts, ends = np.sort(np.concatenate([s, cuts])), np.sort(np.concatenate([e, cuts]))
    keep = ~np.isin(textkit.word_hashes(b, starts, ends, False), _STOPS)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, rows[np.searchsorted(s, starts, "right") - 1]


def tokens(b: np.ndarray, s: np.ndarray, e: np.ndarray, rows: np.ndarray):
    """(start, end, row, hash with names as they are, with names replaced, is a name, type but for names, hash of the word itself) of each token of a piece."""
    s, e, rows = _characters(b, s, e, rows)
    n = len(b)
    count = lambda kind: np.concatenate([[0], np.cumsum(kind[b], dtype=np.int32)])
    body = ~_PUNCT[b]
    nxt = np.minimum.accumulate(np.where(body, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, np.int64)
    prv = np.maximum.accumulate(np.where(body, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    ts, te = (nxt[s], prv[e - 1] + 1) if len(s) else (s, e)
    keep = te > ts
    # a sentence starts at a row's first word, after a newline, and after a word that ends in . ! ? or :
    lines = np.concatenate([[0], np.cumsum(b == 10, dtype=np.int32)])
    first = np.ones(len(s), bool)
    if len(s) > 1:
        last = b[e[:-1] - 1]
        first[1:] = (rows[1:] != rows[:-1]) | (lines[s[1:]] > lines[e[:-1]]) | np.isin(last, np.frombuffer(b".!?:", np.uint8))
    ts, te, rows, first = ts[keep], te[keep], rows[keep], first[keep]
    literal = textkit.word_hashes(b, ts, te)
    digits, letters = count(_DIGIT), count(_LETTER)
    d, a = digits[te] - digits[ts] > 0, letters[te] - letters[ts] > 0
    number, glued = d & ~a, d & a & _DIGIT[b[ts]]
    unit = np.zeros(len(ts), bool)
    if len(ts) > 1:
        unit[1:] = number[:-1] & (rows[1:] == rows[:-1]) & np.isin(literal[1:], _UNIT_HASHES)
    long = te - ts > 1
    c0, c1 = b[ts], b[np.minimum(ts + 1, max(n - 1, 0))] if n else b[ts]
    name = long & ~first & (c0 >= 65) & (c0 <= 90) & (((c1 >= 97) & (c1 <= 122)) | (c1 >= 128)) & ~d
    plain = np.where(number | glued, _NUM, np.where(unit, _UNIT, literal))
    return ts, te, rows, plain, np.where(name, _NAME, plain), name, np.where(number | glued, NUMBER, np.where(unit, UNIT, LITERAL)), literal


def _codes(h: np.ndarray, at: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """A hash of the n values from each of the places at."""
    power, inverse = textkit._grow(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)])
    return textkit.mix((total[at + n] - total[at]) * inverse[at] + n.astype(np.uint64), salt)


def windows(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, bits: np.ndarray | None, lengths: tuple[int, ...] = ()):
    """Yields (row, position, hash, tokens, types of slots, the token after, tokens of the row) for windows that the bit map lets pass (all without one).

    A text with fewer tokens than a window has one window of all its tokens; with lengths, every text also has the windows
    of these lengths that have five literals, and the others as their words unmasked, each once.
    """
    b, s, e, rows = textkit.spans(raw, offsets, i, j)
    ts, te, rows, plain, typed, name, kinds, word = tokens(b, s, e, rows)
    if not len(ts):
        return
    fixed = kinds == LITERAL
    size = np.bincount(rows, minlength=j - i)
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.flatnonzero(rows[: len(ts) - WINDOW + 1] == rows[WINDOW - 1 :]) if len(ts) >= WINDOW else np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < WINDOW))
    names, literals, plains = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (name, fixed & ~name, fixed))
    found = []
    for kind, h, least in (("typed", typed, literals), ("plain", plain, plains)):
        full = least[at + WINDOW] - least[at] >= LITERALS
        has = np.ones(len(at), bool) if kind == "typed" else names[at + WINDOW] > names[at]
        use = at[has & full]
        code = np.zeros(len(use), np.uint64)
        for k in range(WINDOW):
            code = code * np.uint64(0x9FB21C651E98DF25) + h[use + k]
        found.append((kind, use, np.full(len(use), WINDOW), textkit.mix(code, 21)))
        # with too few literals: up to the fifth, if the row has it
        wide = at[~full]
        end = np.searchsorted(least, least[wide] + LITERALS)
        ok = end <= first[rows[wide] + 1]
        wide, end = wide[ok], end[ok]
        if kind == "plain":
            ok = names[end] > names[wide]
            wide, end = wide[ok], end[ok]
        found.append((kind, wide, end - wide, _codes(h, wide, end - wide, 21)))
        whole = short if kind == "typed" else short[names[first[short + 1]] > names[first[short]]]
        found.append((kind, first[whole], size[whole], _codes(h, first[whole], size[whole], 22)))
    exact = [(at, np.full(len(at), WINDOW)), (first[short], size[short])]
    for k in lengths:
        use = np.flatnonzero(rows[: len(ts) - k + 1] == rows[k - 1 :]) if len(ts) >= k else np.zeros(0, np.int64)
        exact.append((use, np.full(len(use), k)))
        inner = use[size[rows[use]] > k]  # the whole of a short text is above
        for kind, h, least in (("typed", typed, literals), ("plain", plain, plains)):
            full = inner[least[inner + k] - least[inner] >= LITERALS]
            if kind == "plain":
                full = full[names[full + k] > names[full]]
            found.append((kind, full, np.full(len(full), k), _codes(h, full, np.full(len(full), k), 22)))
    for use, n in exact:
        few = plains[use + n] - plains[use] < LITERALS
        use, n = use[few], n[few]
        found.append(("exact", use, n, _codes(word, use, n, 23)))
    for kind, use, n, code in found:
        if bits is not None:
            place = (code >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            ok = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
            use, n, code = use[ok], n[ok], code[ok]
        if kind == "exact" and len(use) and n[0] < WINDOW:
            _, once = np.unique(np.stack([rows[use].astype(np.uint64), code]), axis=1, return_index=True)
            use, n, code = use[once], n[once], code[once]
        for x, k, c in zip(use.tolist(), n.tolist(), code.tolist(), strict=True):
            r = int(rows[x])
            words = [bytes(textkit._LOWER[b[ts[y] : te[y]]]).decode("utf-8", "replace") for y in range(x, min(x + k + 1, int(first[r + 1])))]
            slot = [LITERAL if kind == "exact" else NAME if kind == "typed" and name[y] else int(kinds[y]) for y in range(x, x + k)]
            yield i + r, int(x - first[r]), c - (1 << 64 if c >> 63 else 0), words[:k], slot, (words[k:] or [""])[0], int(size[r])


_SCHEMA = "id long, pos int, code long, words array<string>, slots array<int>, after string, size int"


def _template_windows(rows: DataFrame, bits=None, lengths: tuple[int, ...] = ()) -> DataFrame:
    """rows: (id, text)."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.int32()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches):
        held = bits.value if bits is not None else None
        for batch in batches:
            raw, offsets = textkit.buffers(batch.column(1))
            ids = batch.column(0)
            for i, j in textkit.pieces(offsets):
                found = list(windows(raw, offsets, i, j, held, lengths))
                if found:
                    r, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(r, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds[1:], strict=True))], names)

    return rows.mapInArrow(tidy(run), _SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, coverage, n_windows, changed_slots), one row for each leaked item of a document.

    ``covered`` counts the item's tokens under matching windows of consistent alignments, ``changed_slots`` the slots whose
    value differs (0: the item as it is).  Null ids are left out on either side; null and empty texts and texts without a
    word match nothing; repeated rows count once; other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    items = materialise(_template_windows(benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), "text")), "item-windows").distinct()
    place = F.shiftrightunsigned("code", 64 - MAP_BITS)
    # 64 places a row: 2**18 rows at most
    marked = items.select(F.shiftright(place, 6).alias("p"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(code, {64 - MAP_BITS}) & 63 as int))").alias("bit")).groupBy("p").agg(F.bit_or("bit").alias("bits")).toArrow()
    lengths = tuple(r["size"] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect())
    bits = np.zeros(1 << (MAP_BITS - 6), "<i8")
    bits[marked["p"].to_numpy()] = marked["bits"].to_numpy()
    found = _template_windows(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text"), spark.sparkContext.broadcast(bits.view(np.uint8)), lengths).select(F.col("id").alias("doc_id"), "code", F.col("pos").alias("dpos"), F.col("words").alias("dwords"))
    both = found.join(small(items.withColumnsRenamed({"id": "item_id"})), "code")
    words = F.arrays_zip("slots", "words", "dwords", F.concat(F.slice("words", F.lit(2), F.size("words")), F.array("after")).alias("after"), F.sequence(F.col("pos"), F.col("pos") + F.size("words") - 1).alias("at"))
    pair = both.select("doc_id", "item_id", (F.col("dpos") - F.col("pos")).alias("shift"), "pos", F.size("words").alias("n"), "size", words.alias("z"))
    slot = lambda z: F.struct(z["at"].alias("at"), z["slots"].alias("type"), z["words"].alias("a"), F.when(z["slots"] == NUMBER, z["after"]).alias("after"), z["dwords"].alias("b"))
    pair = pair.withColumn("z", F.transform(F.filter("z", lambda z: (z["slots"] > LITERAL) | (z["words"] != z["dwords"])), slot))
    alignment = ["doc_id", "item_id", "shift"]
    line = pair.groupBy(*alignment).agg(
        F.array_distinct(F.flatten(F.collect_set("z"))).alias("m"),
        F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)))).alias("at"),
        F.countDistinct("pos").alias("n"),
        F.max("size").alias("size"),
    )
    line = materialise(line, "alignments")
    # (key, value) of each slot, names both ways; a literal that differs is a clash of hashes and agrees with nothing
    both_ways = F.flatten(F.transform("m", lambda x: F.when(x["type"] == NAME, F.array(F.struct(x["type"], x["a"], F.lit("").alias("after"), x["b"]), F.struct(F.lit(-NAME).alias("type"), x["b"].alias("a"), F.lit("").alias("after"), x["a"].alias("b")))).otherwise(F.array(F.struct(x["type"], x["a"], F.coalesce(x["after"], F.lit("")).alias("after"), x["b"])))))
    votes = line.select(*alignment, F.explode(both_ways).alias("x")).groupBy(*alignment, "x").agg(F.count("*").alias("n")).groupBy(*alignment, "x.type", "x.a", "x.after").agg(F.max("n").alias("agree"), F.sum("n").alias("n"))
    votes = votes.groupBy(*alignment, "type").agg(F.sum("agree").alias("agree"), F.sum("n").alias("n")).where((F.col("agree") <= AGREE * F.col("n")) | (F.col("type") == LITERAL))
    line = line.join(votes.select(*alignment).distinct(), alignment, "left_anti")
    out = line.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("covered"),
        F.max("size").cast("long").alias("item_tokens"),
        F.sum("n").alias("n_windows"),
        F.min(F.size(F.array_distinct(F.transform(F.filter("m", lambda x: x["a"] != x["b"]), lambda x: F.struct(x["a"], x["b"]))))).cast("long").alias("changed_slots"),
    )
    out = out.withColumn("coverage", F.col("covered") / F.col("item_tokens"))
    return out.where(F.col("covered") >= cover * F.col("item_tokens")).select("doc_id", "item_id", "covered", "item_tokens", "coverage", "n_windows", "changed_slots")


def decontaminate(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id has no leak; a null doc_id stays."""
    return without(docs, materialise(leaks(docs, benchmark, cover).select("doc_id").distinct(), "leaked"))

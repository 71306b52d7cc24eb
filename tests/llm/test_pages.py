"""Archives, page text and URL filters."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docsearch.llm import html, urls, warc

PAGES = [(1, "http://a.b/x", "<p>é same</p>"), (5, "http://a.b/y\r\nX: 1", "<p>é same</p>"), (3, None, None), (4, "u", ""), (9, "v", "other" * 5000), (None, "w", "other" * 5000), (9, "v", "other" * 5000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record_type string")
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        top = None if i is None else max(j for j, _, x in PAGES if j is not None and (x or "") == (h or ""))
        response = i is None or top == i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else top, 0))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def records(n=6):
    return [warc.record(k, f"http://x/{k}", f"<p>page {k}</p>" * 20, None) for k in range(n)]


def ids(found):
    return [int(x[0]["warc-record-id"][10:-1]) for kind, _, _, x, *_ in found if kind == "record"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.member(r) if packed else r for r in records()]
    whole = b"".join(parts)
    assert ids(warc.salvage(whole)) == list(range(6))
    at = len(parts[0]) + len(parts[1])
    inside = at + (60 if packed else len(parts[2]) - 100)  # a bare record's header has no digest
    for broken, want, gaps in (
        (whole[:inside] + b"\xff" * 8 + whole[inside + 8 :], [0, 1, 3, 4, 5], 1),
        (whole[: inside - 20] + whole[inside:], [0, 1, 3, 4, 5], 1),
        (b"junk" + whole, list(range(6)), 1),
        (whole + b"\x1f\x8b\x08 tail WARC/1.1\r\n", list(range(6)), 1),
        (whole[:-9], list(range(6)) if packed else [0, 1, 2, 3, 4], 1),  # the member lacks its checksum, the record has its own
        (whole[:at] + b"noise WARC/1.1\r\nContent-Length: 5\r\n\r\n" + whole[at:], list(range(6)), 1),
    ):
        found = list(warc.salvage(broken))
        assert ids(found) == want
        assert sum(kind == "gap" for kind, *_ in found) >= gaps
        edges = [(a, b) for _, a, b, *_ in found]
        assert edges[0][0] == 0 and edges[-1][1] == len(broken) and all(x[1] == y[0] for x, y in zip(edges, edges[1:], strict=False))
    assert list(warc.salvage(b"")) == [] and [k for k, *_ in warc.salvage(b"nothing here")] == ["gap"]


def test_salvage_digest_and_members():
    r = records(2)
    changed = r[0].replace(b"page 0", b"page X", 1)
    found = list(warc.salvage(zlib.compress(changed, wbits=31) + warc.member(r[1])))
    assert ids(found) == [1] and "digest" in found[0][3]
    assert all(warc.member(b"x" * n)[-1] == 0 for n in (0, 1, 100))


def test_salvage_inside_members():
    r = records(3)
    changed = [r[0], r[1].replace(b"page 1", b"page X", 1), r[2]]
    found = list(warc.salvage(zlib.compress(b"".join(changed), wbits=31) + warc.member(records(5)[4])))
    assert ids(found) == [0, 2, 4] and [(x[4], x[5]) for x in found if x[0] == "gap"] == [(len(r[0]), len(r[0]) + len(r[1]))]
    noise = random.Random(1).randbytes(3000)
    packed = zlib.compress(r[0] + r[1] + warc.record(2, noise.hex(), noise.hex(), None), wbits=31)
    found = list(warc.salvage(packed[:-600] + warc.member(records(5)[4])))
    assert ids(found) == [0, 1, 4] and [(x[1], x[2]) for x in found if x[0] == "gap"] == [(0, len(packed) - 600)]
    assert [x[1:3] for x in found if x[0] == "record"][:2] == [(0, 0), (0, 0)]
    assert ids(warc.salvage(zlib.compress(b"no record here", wbits=31))) == []
    assert ids(warc.salvage(zlib.compress(b"x" * 3_000_000 + b"".join(r), wbits=31))) == [0, 1, 2]


def test_salvage_is_linear():
    one = warc.member(warc.record(1, "u", random.Random(2).randbytes(2000).hex(), None))
    long = warc.record(2, "u", "x" * 5_000_000, None)
    took = []
    for n in (2000, 20000):
        data = one * n + b"\x1f\x8b\x08WARC/1.1\r\n" * 1000 + long
        began = time.process_time()
        found = [x[0] for x in warc.salvage(data)]
        took.append(time.process_time() - began)
        assert found.count("record") == n + 1 and found.count("gap") == 1
    assert took[1] < 20 * took[0] + 1


def test_gaps_are_rows(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"bad" + b"".join(map(warc.member, records(3))))
    (tmp_path / "b.warc").write_bytes(b"")
    out = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.start, r.end) for r in out if r.gap) == [(0, 3)] and sum(r.gap is None for r in out) == 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>side</aside><article><header><h1>Head &amp; line</h1></header><p><b>One  <i>two</i><br>three<p>Four&nbsp;&lt;5&gt;
<div class="share">Share</div><script>var a = "</p>";</script><form><input>Send</form><ul><li>x<li>y</ul><section id="comments"><p>nice!</p></section></article>
<div class="sidebarBox">z</div><footer>&copy; me</footer>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & line\nOne two three\nFour <5>\nx\ny"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x") == ""
    assert html.main_text("plain &amp text <b>bold</b>") == "plain & text bold"
    assert html.main_text("<p>a<p>b</b></i></p>c<!-- x --><table><tr><td>1<td>2</table><p>cut <a href='") == "a\nb\nc\n1\n2\ncut"
    assert html.main_text("<div>" * 3000 + "deep") == "deep"


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()
TREE = "page_id long, url string, html string, text string, host string, node long, kind int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "h", 1, 2) for r in rows], TREE)


def said(k, n=12):
    r = random.Random(k)
    return " ".join(r.choices(WORDS, k=n)) + f" {k}"


def plain_tree(pages):
    """Brute force of the style tree: (host, node) to (contents, content, presentation, importance)."""
    texts, shapes, kinds, above = defaultdict(set), defaultdict(dict), {}, {}
    for host, page in pages:
        found = {}
        blocks = html.parse(page, host, shapes=found)
        words = "\n".join([t for _, k, _, t in blocks if k == html.ARTICLE] or [t for _, k, _, t in blocks if k != html.FURNISHED] or [t for *_, t in blocks]).lower().split()
        key = frozenset(" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2)))  # the fixtures' pages differ or are copies
        for n, _, _, t in blocks:
            texts[n].add((t, key))
        for n, (kind, up, tags) in found.items():
            kinds[n], above[n] = max(kind, kinds.get(n, 0)), up
            shapes[n][key] = max(shapes[n].get(key, ()), tuple(tags))
    out, own = {}, {}
    for n in shapes:
        m = len(shapes[n])
        count = Counter(t for t, _ in texts[n])
        met, shown = sum(c * (c - 1) for c in count.values()), sum(count.values())
        own[n] = min(1.0, -math.log((met + html.PAIRS * html.RATE[kinds[n]]) / (shown * (m - 1) + html.PAIRS)) / math.log(html.REPEATS)), sum(c * len(t) for t, c in count.items())
    for n in shapes:
        m, below = len(shapes[n]), [own[x] for x in shapes if n == x or n in above[x]]
        chars = sum(c for _, c in below)
        if chars:
            content = sum(i * c for i, c in below) / chars
            pres = -sum(c / m * math.log(c / m) for c in Counter(shapes[n].values()).values()) / math.log(m) if m > 1 else 0.0
            leaf = not any(shapes[n].values())
            out[n] = m, content, pres, content if leaf else 0.8 * content + 0.2 * pres
    return out


def test_style_tree(spark):
    page = lambda k: f"<body><div class='main'><p>{said(k)}</p></div><div class='strip'><span>Same words on every page</span><ul><li>a<li>b</ul></div></body>"
    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(30)] + [(99, "http://other.org/1", page(1)), (98, None, None), (1, "http://h.org/1", page(1))]
    df = frame(spark, rows)
    out = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert out[3] == (said(3), len(said(3))) and out[99][0] == f"{said(1)}\nSame words on every page\na\nb" and out[98] == ("", 0)
    assert html.extract(df).count() == len(rows) and html.extract(df.limit(0)).count() == 0
    # without the tree nothing would go
    assert html.main_text(page(3)) == f"{said(3)}\nSame words on every page\na\nb"


def test_style_tree_is_that_of_brute_force(spark):
    ads = [f"advert number {k} buy now" for k in range(5)]
    pages = []
    for k in range(40):
        more = "".join(f"<p>{said(100 * k + j)}</p>" for j in range(k % 4))
        pages.append(("h.org", f"<body><nav><ul><li>Home<li>{WORDS[k % 3]}</ul></nav><div class=box><p>{said(k, 30)}</p>{more}</div><div class='x {k}'>{ads[k % 5]}</div>{'<div class=odd>once</div>' if k == 7 else ''}</body>"))
        pages.append(("h.org", f"<article><p>{said(5000 + k)}</p><div class=tail>The end of it</div></article><div class=ad>{ads[k % 5]}</div>"))
    want = plain_tree(pages)
    got = {r.node: r for r in html.style_tree(spark.createDataFrame(pages, "host string, html string").repartition(3)).collect()}
    assert got.keys() == want.keys()
    for n, (m, *values) in want.items():
        r = got[n]
        # the operator knows contents by one minimum hash, so a few different pages may be one
        assert abs(r.contents - m) <= 0.2 * m + 1 and np.allclose([r.content, r.presentation, r.importance], values, atol=0.12), (r, m, values)


def test_pages_without_article(spark):
    menu = "".join(f"<li>{w}" for w in WORDS)
    page = lambda k, body: f"<body><div id=top><ul>{menu}</ul></div><div class=box><h2>{said(k, 4)}</h2>{body}</div><div class=box2><p>Read on in the archive</p></div></body>"
    rows = [(k, "http://h.org/", page(k, f"<p>{said(k)}</p><p>{said(1000 + k)}</p>")) for k in range(25)]
    rows += [(100 + k, "http://few.org/", page(k, f"<p>{said(k)}</p>")) for k in range(2)]
    out = {r.page_id: r.text for r in html.extract(frame(spark, rows)).collect()}
    assert all(out[k] == f"{said(k, 4)}\n{said(k)}\n{said(1000 + k)}" for k in range(25))
    assert "archive" in out[100]  # two pages show nothing yet


def test_the_tree_overrules_marks(spark):
    # furniture by name whose texts are all different is content, and a note in all articles is none; comments never are text
    page = lambda k: f"<div class=promo><p>{said(k, 30)}</p></div><div class=promotion>Buy</div><div class=comments><p>{said(9000 + k)}</p></div>"
    story = lambda k: f"<nav>Menu</nav><article><p>{said(k, 30)}</p><div class=end>Thank you for reading</div><div class=comments>{said(9000 + k)}</div></article>"
    rows = [(k, "http://p.org/", f"<body>{page(k)}</body>") for k in range(150)] + [(1000 + k, "http://s.org/", story(k)) for k in range(30)] + [(2000, "http://one.org/", f"<body>{page(1)}x</body>"), (2001, "http://one.org/", story(1))]
    out = {r.page_id: r.text for r in html.extract(frame(spark, rows)).collect()}
    assert all(out[k] == said(k, 30) for k in range(150)) and all(out[1000 + k] == said(k, 30) for k in range(30))
    assert out[2000] == "x" and out[2001] == f"{said(1, 30)}\nThank you for reading"


def test_tree_alone_on_the_tables(spark):
    """On a host with some hundred pages of the tables, the tree alone separates the articles, without any mark."""
    names = {"nav": "n", "article": "a", "footer": "f"}
    found = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(1200).collect()]
    bare = [re.sub(r"<(/?)(nav|article|footer)>", lambda m: "</div>" if m[1] else f'<div class="{names[m[2]]}">', page).replace('"ad"', '"x"') for page in found]
    bare = [re.sub(r"&copy; \S+", "&copy; h.org", x) for x in bare]
    low = {r.node for r in html.style_tree(spark.createDataFrame([("h.org", x) for x in bare], "host string, html string")).collect() if not r.stays}
    assert all(html.main_text(x, "h.org", frozenset(low)) == html.main_text(page) for x, page in zip(bare, found, strict=True))
    assert html.main_text(bare[0], "h.org") != html.main_text(found[0])


def test_long_and_odd_pages(spark):
    rows = [(1, "u", "<div>" * 3000 + "deep" + "<p>x</p>" * 5), (2, "http://a/", "<table>" + "<tr><td>a<td>b" * 20000 + "</table>"), (3, "http://a/", "word " * 300000), (4, "http://A/", "<article></article><div>text</div>"), (5, "http://a/", "<!-- <article> --><div>text</div>"), (None, "http://a/", "<p>z")]
    out = {r.page_id: r for r in html.extract(frame(spark, rows)).collect()}
    assert out[1].text == "deep\nx\nx\nx\nx\nx" and out[2].n_chars == 79999 and out[3].n_chars == 1499999 and out[4].text == out[5].text == "text" and out[None].text == "z"


def test_url_rules(spark):
    cases = {
        "https://A.Example.NET/en/5?x": ("a.example.net", "/en/5", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "http://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/", "block"),
        "ftp://w.org/fr/#t": ("w.org", "/fr/", "org/fr/", "allow"),
        "http://net": ("net", "", None, "allow"),
        "http://x.net?q=/": ("x.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(cases)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, labels).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge(df.limit(0), labels).count() == 0


def test_url_templates(spark):
    rows, marks = [], []
    for k in range(400):
        rows.append((k, f"http://h.edu/{'spam' if k % 4 == 0 else 'news'}/{k}.html"))
        marks.append((k, int(k % 4 != 0)))
    rows += [(1000 + k, f"http://h.edu/tags/{chr(97 + k % 26)}{chr(97 + k // 26)}/x") for k in range(100)]
    rows += [(None, "http://h.edu/spam/7.html"), (3, "http://h.edu/news/3.html")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, 7)], "doc_id long, quality int")
    out = urls.judge(df, labels).collect()
    assert len(out) == len(rows)
    assert all(r.verdict == ("block" if "/spam/" in r.path else "allow") for r in out)
    src = df.select("page_id", *(c.alias(n) for c, n in zip(urls.parts(df["url"]), ("host", "path"), strict=True)))
    shown = {r.template for r in urls.templates(src, labels).collect()}
    assert {t for t in shown if "tags" in t} == {"/tags/*/x"} and len(shown) <= 3


def plain_verdicts(pages, quality):
    """Brute force of the path-template tree: (host, path) to verdict, for urls that no rule decides."""

    def typed(path):
        long = lambda x: re.fullmatch("[0-9a-fA-F-]{8,}", x) and re.search("[0-9]", x) and re.search("[a-fA-F]", x)
        return tuple("{x}" if long(x) else re.sub("[0-9]+", "{n}", x) for x in path.split("/")[1:])

    def z(g, k, g0, k0):
        p = (g + g0 + 1) / (k + k0 + 2)
        return abs((g + 0.5) / (k + 1) - (g0 + 0.5) / (k0 + 1)) / math.sqrt(p * (1 - p) * (1 / (k + 1) + 1 / (k0 + 1)))

    stats = defaultdict(lambda: [0, 0, 0])  # pages, good, labelled
    for i, host, path in pages:
        s = stats[host, typed(path)]
        s[0] += 1
        s[1] += quality.get(i) == 1
        s[2] += i in quality
    leaf = {}
    for host in {h for h, _ in stats}:
        work = [((), 0, [p for h, p in stats if h == host])]
        while work:
            tpl, depth, paths = work.pop()
            add = lambda ps, k: sum(stats[host, p][k] for p in ps)
            leaf |= {(host, p): tpl for p in paths if len(p) <= depth}
            paths = [p for p in paths if len(p) > depth]
            if not paths:
                continue
            if depth >= urls.LEVELS and not (len(paths) > 1 and 0 < add(paths, 1) < add(paths, 2)):
                leaf |= {(host, p): (*tpl, "**") for p in paths}
                continue
            kids = defaultdict(list)
            for p in paths:
                kids[p[depth]].append(p)
            total, g0, k0, wild = add(paths, 0), add(paths, 1), add(paths, 2), []
            for seg, ps in sorted(kids.items()):
                n, g, k = (add(ps, j) for j in range(3))
                apart = k >= urls.SMOOTHING and z(g, k, g0 - g, k0 - k) > max(urls.Z, math.sqrt(2 * math.log(len(kids))))
                if len(kids) > urls.MAX_CHILDREN and n * urls.MAX_CHILDREN < total and not apart:
                    wild += ps
                else:
                    work.append(((*tpl, seg), depth + 1, ps))
            if wild:
                work.append(((*tpl, "*"), depth + 1, wild))
    name = {x: x[1] for x in {(h, leaf[h, p]) for h, p in stats}}
    count = lambda key: [sum(s[j] for (h, p), s in stats.items() if key(h, p)) for j in (1, 2)]
    for d in range(max(len(t) for _, t in name)):
        groups = defaultdict(set)
        for (h, _), t in name.items():
            if len(t) > d:
                groups[h, t[:d], t[d + 1 :]].add(t)
        for (h, a, b), ts in groups.items():
            rows = sorted((g / k if k else -1.0, t, g, k) for t in ts for g, k in [count(lambda h2, p, h=h, t=t: h2 == h and name[h, leaf[h2, p]] == t)])
            cluster = [[rows[0]]]
            for x, y in zip(rows, rows[1:], strict=False):
                if z(y[2], y[3], x[2], x[3]) > urls.Z:
                    cluster.append([])
                cluster[-1].append(y)
            for c in cluster:
                to = "|".join(sorted(x[1][d] for x in c))
                for x in c:
                    name |= {(h2, t): (*a, to, *b) for (h2, t), now in name.items() if h2 == h and now == x[1]}
    good, labelled = count(lambda h, p: True)
    out = {}
    for i, host, path in pages:
        g, k = count(lambda h, p: h == host and name[h, leaf[h, p]] == name[host, leaf[host, typed(path)]])  # noqa: B023
        hg, hk = count(lambda h, p: h == host)  # noqa: B023
        prior = (hg + urls.SMOOTHING * (good + 1) / (labelled + 2)) / (hk + urls.SMOOTHING)
        out[i] = "block" if (g + urls.SMOOTHING * prior) / (k + urls.SMOOTHING) < urls.LEAST_PURITY else "allow"
    return out


def test_url_templates_are_those_of_brute_force(spark):
    r = random.Random(8)
    pages, quality = [], {}
    for i in range(1500):
        host = r.choice(["a.edu", "a.edu", "b.edu"])
        path = [r.choice(["news", "spam", "tags", "x"])]
        if path[0] == "tags":
            path.append(f"t{chr(97 + r.randrange(26))}{chr(97 + r.randrange(3))}")
        path += r.choices(["p", "q", "12", "0a1b2c3d"], k=r.randint(0, 3)) + (["deep", r.choice(["bad", "fine"]), str(i)] if r.random() < 0.5 else [])
        pages.append((i, host, "/" + "/".join(path)))
        if r.random() < 0.7:
            bad = "spam" in path or "bad" in path or "tcc" in path or "tab" in path
            quality[i] = int(r.random() < (0.1 if bad else 0.8))
    df = spark.createDataFrame([(i, f"http://{h}{p}", "t", "u") for i, h, p in pages], "page_id long, url string, typed string, quality string")
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    got = {x.page_id: x.verdict for x in urls.judge(df, labels).collect()}
    want = plain_verdicts(pages, quality)
    assert {"block", "allow"} == set(want.values()) and {i: (got[i], pages[i]) for i in want if got[i] != want[i]} == {}


def test_url_templates_small_sections_and_deep_paths(spark):
    rows, marks = [], []

    def add(path, good):
        k = len(rows)
        rows.append((k, f"http://h.edu{path}"))
        marks.append((k, good))

    for c in range(60):  # one section in sixty, under a fiftieth of the pages
        name = f"{chr(97 + c % 26)}{chr(97 + c // 26)}"
        for k in range(30):
            add(f"/{name}/{k}.html", int(name != "cb"))
    for k in range(60):
        add(f"/w/a/b/c/{'bad' if k % 2 else 'fine'}/{k}.html", 1 - k % 2)
    for k in range(26):  # far below, with labels enough to outweigh the host
        add(f"/v/a/b/c/d/e/f/g/{'bad' if k % 2 else 'fine'}/{k}.html", 1 - k % 2)
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    out = {r.page_id: r.verdict for r in urls.judge(df, labels).collect()}
    assert out == {k: "allow" if good else "block" for k, good in marks}


def test_copies_keep_all_of_an_article(spark):
    body = "<article><div>plain words</div><div class='box'><p>one</p><p>two</p></div><ul><li>item</ul><table><tr><td>cell</table><figure><figcaption>caption</figcaption></figure></article>"
    rows = [(k, "http://c.org/", f"<body>{body}<div class='strip'>Same</div></body>") for k in range(40)]
    near = [(100 + k, "http://n.org/", f"<article><h1>The same head</h1><p>{said(7, 60)}</p><p>{said(k % 10)}</p></article><footer>{k}</footer>") for k in range(40)]
    out = {r.page_id: r.text for r in html.extract(frame(spark, rows + near)).collect()}
    assert {out[k] for k in range(40)} == {"plain words\none\ntwo\nitem\ncell\ncaption"}
    assert all(out[100 + k] == f"The same head\n{said(7, 60)}\n{said(k % 10)}" for k in range(40))

from __future__ import annotations

import json

import pytest

from docsearch.config import ChunkerConfig, Config, RetrieverConfig, StoreConfig
from docsearch.errors import ConfigError, GenerationError, IndexConfigMismatchError, IndexingError
from docsearch.operators import answer as A
from docsearch.pipeline import Pipeline, hashed_embedder, scorer_self_test, self_test, sound
from docsearch.sources.files import scan
from docsearch.sources.parse import parse
from pyspark.sql import functions as F
from tests.packages import docx, xlsx

BOOK = xlsx(
    [
        ("단가표", [["품목코드", "품목", "단가"]] + [[f"{i:03d}", f"품목{i}", 100 * i] for i in range(1, 6)], [], False),
        ("견적", [["견적서 합계", None, None, None, None], ["구분", "품목", "가격", None, "할인율"], [None, None, "단가", "합계", None], ["사무용품", "A4용지", 100, 300, (0.15, 1)], [None, "볼펜", 50, 50.5, (45853, 2)]], ["A1:E1", "A2:A3", "B2:B3", "C2:D2", "E2:E3", "A4:A5"], False),
        ("빈시트", [], [], False),
        ("숨김", [["x"]], [], True),
    ]
)
RULES = docx([("H1", "제1장 총칙"), ("", "이 규정은 휴가 사용 절차를 정한다."), ("H2", "휴가 일수"), ("L", "연차"), [["구분", "일수"], ["연차", "15|일"], ["병가", "10일"]]])


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    (d / ".hidden").mkdir(parents=True)
    (d / "견적.xlsx").write_bytes(BOOK)
    (d / "규정.docx").write_bytes(RULES)
    (d / "빈.docx").write_bytes(b"")
    (d / "잠김.docx").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x" * 20)
    (d / "깨짐.xlsx").write_bytes(b"not a zip")
    (d / "manual.pdf").write_bytes(b"%PDF")
    (d / "~$규정.docx").write_bytes(b"x")
    (d / "notes.txt").write_text("hi")
    (d / ".hidden" / "a.docx").write_bytes(RULES)
    return d


class Client:
    def __init__(self, text="휴가는 15일입니다 [1].", **more):
        self.text, self.more, self.asked = text, more, []

    def complete(self, **request):
        self.asked.append(request)
        if isinstance(self.text, Exception):
            raise self.text
        return A.Reply(self.text, **self.more)


def make(spark, tmp_path, **more):
    config = Config(store=StoreConfig(persist_dir=str(tmp_path / "store")), chunker=ChunkerConfig(parent_min_chars=10), **more.pop("groups", {}))
    return Pipeline(spark, config, **more)


def test_parsing(spark, folder):
    docs, failures = parse(scan(spark, str(folder)))
    got = {r.source: r for r in docs.collect()}
    assert set(got) == {"견적.xlsx", "규정.docx"}
    book = got["견적.xlsx"].markdown
    assert json.loads(got["견적.xlsx"].metadata) == {"단가표": "markdown_table", "견적": "narrative"}
    assert "## 시트: 단가표" in book and "| 001 | 품목1 | 100 |" in book and "견적서 합계" in book
    assert "[행4] 구분: 사무용품, 품목: A4용지, 가격_단가: 100, 가격_합계: 300, 할인율: 15%" in book
    assert "[행5] 구분: 사무용품, 품목: 볼펜, 가격_단가: 50, 가격_합계: 50.5, 할인율: 2025-07-15" in book
    assert got["견적.xlsx"].warnings == ["empty sheet skipped: 빈시트", "hidden sheet skipped: 숨김"]
    assert "# 제1장 총칙" in got["규정.docx"].markdown and "- 연차" in got["규정.docx"].markdown and "| 연차 | 15\\|일 |" in got["규정.docx"].markdown
    bad = {r.source_path.rpartition("/")[2]: r.error_type for r in failures.collect()}
    assert bad == {"빈.docx": "EmptyDocumentError", "잠김.docx": "EncryptedDocumentError", "깨짐.xlsx": "ParserError", "manual.pdf": "ParserError"}


def test_synchronisation_and_answers(spark, folder, tmp_path):
    p = make(spark, tmp_path, client=Client())
    first = p.ingest(str(folder))
    assert len(first.indexed) == 2 and len(first.failures) == 4 and not first.unchanged
    again = p.ingest(str(folder))
    assert len(again.unchanged) == 2 and not again.indexed and len(again.failures) == 4
    a = p.query("휴가 일수는?")
    assert a.grounded and a.citations[0]["index"] == 1 and "[1]" in a.answer and "\n\n참고 문서\n- [1] " in a.format()
    assert p.client.asked[0]["message"].startswith("<documents>\n<document index=\"1\"") and p.client.asked[0]["message"].endswith("질문: 휴가 일수는?")
    assert {r.source for r in p.retrieve("휴가", {"source": "견적.xlsx"}).collect()} == {"견적.xlsx"}
    assert p.retrieve("휴가", {"nope": 1}).count() == 0
    old = {r.doc_id for r in p.index.table("children").collect()}
    (folder / "규정.docx").write_bytes(docx([("H1", "새 규정"), ("", "출장비는 영수증으로 정산한다.")]))
    (folder / "견적.xlsx").unlink()
    third = p.ingest(str(folder))
    assert [x.rpartition("/")[2] for x in third.indexed] == ["규정.docx"] and [x.rpartition("/")[2] for x in third.removed] == ["견적.xlsx"]
    children = p.index.table("children").collect()
    assert {r.doc_id for r in children} < old and any("출장비" in r.text for r in children) and not any("휴가" in r.text for r in children)
    for name in ("vectors", "postings"):
        assert {r.child_id for r in p.index.table(name).select("child_id").collect()} == {r.child_id for r in children}
    # a file that fails now keeps what is stored of it
    (folder / "규정.docx").write_bytes(b"broken")
    fourth = p.ingest(str(folder))
    assert not fourth.removed and p.index.table("children").count() == len(children)


def test_updates_touch_their_buckets(spark, folder, tmp_path):
    p = make(spark, tmp_path)
    for n in range(6):
        (folder / f"n{n}.docx").write_bytes(docx([("H1", f"문서 {n}"), ("", f"공통 낱말과 고유 낱말{n} unique{n} 입니다.")]))
    assert p.ingest(str(folder)).counts == {"indexed": 8, "failed": 4}
    before = p.index.pointer()["places"]
    (folder / "n1.docx").write_bytes(docx([("H1", "문서 1"), ("", "다른 내용 replaced 이다.")]))
    (folder / "n2.docx").unlink()
    report = p.ingest(str(folder))
    assert report.counts == {"indexed": 1, "removed": 1, "unchanged": 6, "failed": 4} and "indexed 1, unchanged 6, removed 1, failed 4" == report.summary()
    after = p.index.pointer()["places"]
    moved = {b for k in ("children", "postings", "manifest") for b in before[k].keys() | after[k].keys() if before[k].get(b) != after[k].get(b)}
    assert 1 <= len(moved) <= 2 and before["terms"] != after["terms"]
    # what was added and subtracted is what a new index has
    fresh = make(spark, tmp_path / "again")
    fresh.ingest(str(folder))
    for name in ("terms", "totals", "postings", "children"):
        columns = [c for c in p.index.table(name).columns if c not in ("headers", "warnings")]
        rows = [sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in x.index.table(name).select(*columns).collect()) for x in (p, fresh)]
        assert rows[0] == rows[1] and rows[0]
    assert p.index.expire() == [] and p.index.table("children").count() == fresh.index.table("children").count()
    # a folder goes once no bucket is read from it
    (folder / "n3.docx").unlink()
    p.ingest(str(folder))
    used = {at for by in p.index.pointer()["places"].values() for at in by.values()}
    kept = {x for x in p.index.files.folders(p.index.folder)}
    assert set(p.index.expire(0)) == kept - used


def test_docx_tables():
    from xml.etree import ElementTree

    from docsearch.sources.ooxml import _table

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda text, props="", inner="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p>{inner}</w:tc>"
    read = lambda *rows: _table(ElementTree.fromstring(f'<w:tbl xmlns:w="{w}">' + "".join(f"<w:tr>{''.join(r)}</w:tr>" for r in rows) + "</w:tbl>"))
    nested = f"<w:tbl><w:tr>{cell('inner')}</w:tr></w:tbl>"
    assert read([cell("a"), cell("b", inner=nested)], [cell("c"), cell("d")]) == "| a | b |\n|---|---|\n| c | d |"
    assert read([cell("a", '<w:gridSpan w:val="2"/>')], [cell("c"), cell("d")]) == "| a | a |\n|---|---|\n| c | d |"
    down = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    assert read([cell("h"), cell("i")], [cell("a", down[0]), cell("1")], [cell("", down[1]), cell("2")]) == "| h | i |\n|---|---|\n| a | 1 |\n| a | 2 |"
    assert read([cell("")]) == "" and read([cell("a")], [cell("b")]) == "a\n\nb" and read([cell("a"), cell(""), cell("c")]) == "a | c"


def test_missing_parents_are_told(spark, folder, tmp_path):
    p = make(spark, tmp_path, client=Client())
    p.ingest(str(folder))
    whole = p.index.table
    p.index.table = lambda name, buckets=None: whole(name).where("source <> '규정.docx'") if name == "parents" else whole(name, buckets)
    assert any("missing from the store" in w for w in p.query("휴가 일수").warnings)


def test_degradations(spark, folder, tmp_path):
    p = make(spark, tmp_path)
    assert p.query("  ").answer == A.NO_ANSWER and p.query("x").answer == A.NO_ANSWER
    p.ingest(str(folder))
    assert any("generation failed" in w for w in p.query("휴가").warnings)
    for client, want in (
        (Client("근거 없는 말"), lambda a: not a.grounded and any("without citations" in w for w in a.warnings)),
        (Client(A.NO_ANSWER), lambda a: not a.grounded and not any("without" in w for w in a.warnings)),
        (Client("x [9]."), lambda a: a.answer == "x." and any("[9]" in w for w in a.warnings)),
        (Client("", stop_reason="refusal", category="c"), lambda a: "거절" in a.answer),
        (Client("x [1]", stop_reason="max_tokens"), lambda a: any("cut off" in w for w in a.warnings)),
        (Client(type("Slow", (TimeoutError,), {})("slow")), lambda a: a.citations and any("can't be reached" in w for w in a.warnings)),
    ):
        p.client = client
        assert want(p.query("휴가 일수"))


def test_rerank(spark, folder, tmp_path):
    scorer = lambda question, text: F.when(text.contains("휴가"), 0.9).otherwise(0.2)
    p = make(spark, tmp_path, scorer=scorer, groups={"retriever": RetrieverConfig(rerank_min_score=0.5)})
    p.ingest(str(folder))
    rows = p.retrieve("휴가").collect()
    assert rows and all(r.score == 0.9 and "rerank" in r.retrievers for r in rows)


def test_index_guards(spark, folder, tmp_path):
    make(spark, tmp_path).ingest(str(folder))
    other = Config(store=StoreConfig(persist_dir=str(tmp_path / "store"), embedding_model="other"))
    with pytest.raises(IndexConfigMismatchError):
        Pipeline(spark, other)
    (tmp_path / "store" / "CURRENT").write_text("{")
    with pytest.raises(IndexingError):
        make(spark, tmp_path)
    with pytest.raises(ConfigError):
        make(spark, tmp_path / "new").ingest(str(tmp_path / "missing"))


def test_self_test():
    assert self_test(hashed_embedder()) > 0.99
    spoiled = lambda texts: [[1.0, 0.0] if len(texts) > 1 else [0.0, 1.0] for _ in texts]
    assert self_test(spoiled) < 0.99
    good = hashed_embedder()
    assert sound([spoiled, good], self_test, lambda x: x >= 0.99, "embedding")[0] is good
    with pytest.raises(ConfigError):
        sound([spoiled, None], self_test, lambda x: x >= 0.99, "embedding")


def test_scorer_self_test(spark):
    assert scorer_self_test(spark, lambda q, t: F.when(t.contains("규정"), 0.9).otherwise(0.2)) == 0
    assert scorer_self_test(spark, lambda q, t: F.rand()) > 0.01


def test_request_and_errors():
    from docsearch.config import GenerationConfig

    r = A.request(GenerationConfig(temperature=None, effort="low"), "m")
    assert "temperature" not in r and r["effort"] == "low"
    with pytest.raises(GenerationError) as e:
        A.call(Client(ConnectionError("x")), GenerationConfig(), "m", lambda _: None)
    assert e.value.retryable


@pytest.mark.parametrize(("status", "asked"), [(400, 1), (401, 1), (403, 1), (404, 1), (418, 1), (408, 3), (429, 3), (500, 3), (529, 3)])
def test_retries(status, asked):
    from docsearch.config import GenerationConfig

    fault, pauses = type("StatusError", (Exception,), {"status_code": status})("x"), []
    client = Client(fault)
    with pytest.raises(GenerationError) as e:
        A.call(client, GenerationConfig(max_retries=2), "m", pauses.append)
    assert e.value.retryable == (asked > 1) and len(client.asked) == asked and pauses == [0.5, 1.0][: asked - 1] and str(status) in str(e.value)


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    from docsearch.__main__ import main

    monkeypatch.chdir(tmp_path)
    store = ["--store", str(tmp_path / "store")]
    assert main([*store, "ingest", str(folder)], spark) == 0
    assert main([*store, "query", "휴가", "--source", "규정.docx"], spark) == 0
    assert main([*store, "ingest", str(tmp_path / "none")], spark) == 2
    assert "indexed 2" in capsys.readouterr().out


def test_watch(spark, folder, tmp_path):
    from docsearch.streaming.watch import watch

    p = make(spark, tmp_path)
    watch(p, str(folder), str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert p.index.table("manifest").count() == 2


def test_pdf_routing():
    from docsearch.config import ParserConfig
    from docsearch.errors import EmptyDocumentError, ParserError
    from docsearch.sources import pdf

    c, pages = ParserConfig(), ["page one " * 20, "page two " * 20]
    try:
        pdf.BACKENDS |= {"probe": lambda b: pages}
        text, name, meta, _ = pdf.read_pdf(b"", c)
        assert text.startswith("<!-- page: 1 -->") and (name, meta["route_reason"]) == ("fast", "layout_unavailable")
        pdf.BACKENDS["layout"] = lambda b: ["x"]
        _, name, meta, warnings = pdf.read_pdf(b"", c)
        assert meta["route_reason"] == "layout_fallback" and warnings
        pdf.BACKENDS["layout"] = lambda b: pages
        assert pdf.read_pdf(b"", c)[2]["route_reason"] == "complex_layout"
        pdf.BACKENDS["probe"] = lambda b: ["", ""]
        assert pdf.read_pdf(b"", c)[2]["route_reason"] == "scanned_ocr"
        pdf.BACKENDS["layout"] = lambda b: 1 / 0
        with pytest.raises(ParserError):
            pdf.read_pdf(b"", c)
        del pdf.BACKENDS["layout"]
        with pytest.raises(EmptyDocumentError):
            pdf.read_pdf(b"", c)
        pdf.BACKENDS["probe"] = lambda b: []
        with pytest.raises(EmptyDocumentError):
            pdf.read_pdf(b"", c)
    finally:
        pdf.BACKENDS.clear()

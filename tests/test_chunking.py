from __future__ import annotations

import re

import pytest

from docsearch.config import ChunkerConfig
from docsearch.operators.chunking import Chunker, chunk, parse_table, split_table
from docsearch.operators.splitters import by_headers, recursive

HEAD, RULE = "| 번호 | 무게 | 메모 |", "| --- | ---: | --- |"
ROWS = "\n".join(f"| K{i:02d} | {i * 3} kg | 상자 {i} |" for i in range(60))
TEXT = f"""<!-- page: 1 -->

# 1장 창고

창고를 소개한다.

## 1.1 위치

강가의 벽돌 건물이다.

<!-- page: 2 -->

# 2장 재고

(단위: kg)

{HEAD}
{RULE}
{ROWS}

<!-- page: 3 -->

## 2.1 보관 방법

{"상자는 마른 곳에 두고 매주 살핀다. " * 60}

```sh
# 주석이며 제목이 아니다
| 이것은 | 표가 아니다 |
```

# 3장 마침

마지막으로 적어 두는 글이다.
"""
SMALL = ChunkerConfig(parent_max_chars=600, parent_min_chars=200, child_chunk_chars=200, child_overlap_chars=20)


@pytest.fixture(scope="module")
def result():
    return Chunker(SMALL).split("d1", "t.pdf", TEXT)


def test_fragments_repeat_the_header(result):
    parents, children, _ = result
    tables = [c for c in children if c["chunk_type"] == "table"]
    assert len(tables) > 5 and all(f"{HEAD}\n{RULE}" in c["text"] for c in tables)
    holding = [p for p in parents if "| K" in p["text"]]
    assert len(holding) > 1 and all(HEAD in p["text"] for p in holding)
    rows = [s for c in tables for s in c["text"].split("\n") if s.startswith("| K")]
    assert len(rows) == len(set(rows)) == 60
    captions = [c["text"].split("\n")[1] for c in tables]
    assert captions[0] == "(단위: kg)" and set(captions[1:]) == {"(단위: kg) (계속)"}


def test_tags_pages_and_labels(result):
    parents, children, _ = result
    assert all(x["text"].startswith("[문서명: t.pdf, 섹션: ") for x in parents + children)
    pages = {c["section"]: c["pages"] for c in children}
    assert (pages["1장 창고"], pages["2장 재고"], pages["2장 재고 > 2.1 보관 방법"]) == ("1", "2", "3")
    labels = [p["section"] for p in parents]
    assert "1장 창고 (1.1 위치 포함)" in labels
    assert all("3장" not in x or x == "3장 마침" for x in labels)
    assert not any(all(re.match(r"#+ ", s) for s in p["text"].split("\n")[1:] if s.strip()) for p in parents)
    assert any("# 주석이며 제목이 아니다" in c["text"] for c in children)


def test_references(result):
    parents, children, _ = result
    assert {c["parent_id"] for c in children} <= {p["parent_id"] for p in parents}
    assert len({c["child_id"] for c in children}) == len(children)


def test_no_headers_and_nothing_else():
    parents, children, warnings = Chunker(SMALL).split("d", "t", "제목 없는 글이다. 계속된다. " * 5)
    assert children and warnings and parents[0]["section"] == "본문" and parents[0]["pages"] is None
    assert Chunker(SMALL).split("d", "t", "# 제목\n\n## 소제목")[1] == []


def test_settings_are_checked():
    for bad in ({"child_chunk_chars": 700}, {"parent_min_chars": 601}, {"child_overlap_chars": 200}):
        with pytest.raises(ValueError):
            Chunker(ChunkerConfig(**({"parent_max_chars": 600, "parent_min_chars": 200, "child_chunk_chars": 200, "child_overlap_chars": 20} | bad)))


def test_chunk_operator(spark):
    rows = [("d1", "t.pdf", "/x/t.pdf", "pdf", "test", TEXT), ("d2", "u.pdf", "/x/u.pdf", "pdf", "test", "# only"), ("d3", "v.pdf", "/x/v.pdf", "pdf", "test", None)]
    out = chunk(spark.createDataFrame(rows, "doc_id string, source string, source_path string, file_type string, parser_used string, markdown string"), SMALL).collect()
    assert {r.doc_id: r.error_type for r in out if r.level == "failure"} == {"d2": "ChunkingError", "d3": "ChunkingError"}
    assert [r.headers for r in out if r.section == "1장 창고" and r.level == "child"] == [{"h1": "1장 창고"}]


@pytest.mark.parametrize("size", [1, 5, 17, 60])
def test_recursive_keeps_sizes_and_text(size):
    text = "One sentence. Another one, longer? Yes!\n\nA paragraph here\nand a line"
    out = recursive(text, size)
    assert all(len(x) <= size for x in out)
    assert "".join("".join(out).split()) == "".join(text.split())


def test_recursive_overlap():
    out = recursive("a b c d e f g h", 5, 3)
    assert out == ["a b", "b c", "c d", "d e", "e f", "f g", "g h"] or all(len(x) <= 5 for x in out)


def test_headers_fold_and_stay():
    levels = {"#": "h1", "##": "h2"}
    assert [h for h, _ in by_headers("# A\n\n## B\n\ntext", levels)] == [{"h1": "A", "h2": "B"}]
    assert [h for h, _ in by_headers("# A\n\nx\n\n## B\n\ny\n\n# C\n\nz", levels)] == [{"h1": "A"}, {"h1": "A", "h2": "B"}, {"h1": "C"}]
    assert by_headers("```\n# no\n```\nx", levels)[0][0] == {}


def test_tables():
    t = parse_table(f"cap\n{HEAD}\n{RULE}\n| a | b | c |")
    assert t.caption == "cap" and t.rows == ["| a | b | c |"]
    assert parse_table(f"{HEAD}\n{RULE}\nno row") is None
    long = t._replace(rows=["| " + "x" * 300 + " |", "| b |"])
    assert len(split_table(long, 100)) == 2
    with pytest.raises(ValueError):
        split_table(t, 0)

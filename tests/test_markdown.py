from __future__ import annotations

import pytest

from docsearch.functions.markdown import restore_headings, strip_inline_code
from docsearch.functions import text as T
from pyspark.sql import functions as F

BOOK = """## **정원 가꾸기**

## **펴내며**

여는 글.

## **1장. 흙 고르기** **첫걸음: 준비**

흙 이야기.

## **비가 오래 왔다.**

## **점검 목록**

## **1. 물 빠짐**

## **3부. 여름 정원** **2장. 물 주기: 아침,** **저녁** **얼마나 줄까**

물 이야기.

## **점검 목록**
"""


def test_heading_levels():
    text, stats = restore_headings(BOOK)
    assert [s for s in text.split("\n") if s.startswith("#")] == [
        "# 정원 가꾸기", "# 펴내며", "# 1장. 흙 고르기", "## 첫걸음: 준비", "## 점검 목록", "### 1. 물 빠짐",
        "# 2장. 물 주기: 아침, 저녁", "## 얼마나 줄까", "## 점검 목록",
    ]
    assert "**3부. 여름 정원**" in text and "**비가 오래 왔다.**" in text
    assert (stats["parts_demoted"], stats["demoted"]) == (1, 1)
    assert restore_headings(text) == (text, {"applied": 0})


@pytest.mark.parametrize(
    ("text", "mode", "want", "n"),
    [
        ("`10` 스텝", "symbolic", "10 스텝", 1),
        ("`SQL` `→`", "symbolic", "`SQL` →", 1),
        ("`SQL` `→`", "all", "SQL →", 2),
        ("``x``", "all", "``x``", 0),
        ("`# a`", "all", "`# a`", 0),
        ("a `# 1`", "symbolic", "a # 1", 1),
        ("`a|b`", "all", "`a|b`", 0),
        ("```\n`1`\n```", "all", "```\n`1`\n```", 0),
        ("`1`", "off", "`1`", 0),
        ("`²`", "symbolic", "²", 1),
    ],
)
def test_inline_code(text, mode, want, n):
    assert strip_inline_code(text, mode) == (want, n)


def test_inline_code_mode():
    with pytest.raises(ValueError):
        strip_inline_code("x", "some")


def test_text_functions(spark):
    row = lambda **columns: spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()
    r = row(
        n=T.normalize_text(F.lit("\r\n가\u0000 b \n\n\n\n c d \n")),
        c=T.clean_header(F.lit("**A_b** `c` ## ")),
        t=T.tokenize(F.lit("가격 A4-12 x")),
        e=T.escape_cell(F.lit(" a|b \n c ")),
        p=T.page_number(F.lit(" <!-- page: 12 --> ")),
        q=T.page_number(F.lit("page: 12")),
        s=T.squeeze(F.lit("　a 　 b")),
    )
    assert r.n == "가 b\n\n c d"
    assert r.c == "Ab c"
    assert r.t == ["가격", "a4", "12", "x", "a4-12"]
    assert r.e == "a\\|b c"
    assert (r.p, r.q, r.s) == (12, None, "a b")

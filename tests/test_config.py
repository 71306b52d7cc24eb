from __future__ import annotations

import pytest

from docsearch.config import Config, GenerationConfig, ModelRules, load
from docsearch.errors import ConfigError


@pytest.mark.parametrize(
    "text",
    [
        "nope: 1",
        "chunker: {nope: 1}",
        "chunker: 3",
        "- a",
        "parser: {pdf_strip_symbolic_inline_code: true}",
        "chunker: {child_chunk_chars: 5000}",
        "retriever: {top_n: 0}",
        "retriever: {rerank_min_score: 1.5}",
        "retriever: {dense_weight: 0, sparse_weight: 0}",
        "parser: {pdf_inline_code_strip: some}",
        "generation: {max_tokens: 0}",
        "generation: {effort: huge}",
        "generation: {temperature: 2.0}",
        "generation: {enable_refusal_fallback: true}",
        "a: [",
    ],
)
def test_rejected(tmp_path, text):
    (tmp_path / "c.yaml").write_text(text)
    with pytest.raises(ConfigError):
        Config.from_yaml(tmp_path / "c.yaml")


def test_accepted(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("parser: {large_pdf_size_mb: 300}\nchunker: {headers_to_split_on: [['#', a], ['##', b]]}\nretriever: {top_n: 7}")
    c = Config.from_yaml(tmp_path / "c.yaml")
    assert c.parser.large_pdf_size_mb == 300.0 and isinstance(c.parser.large_pdf_size_mb, float)
    assert c.chunker.headers_to_split_on == (("#", "a"), ("##", "b")) and c.retriever.top_n == 7
    monkeypatch.setenv("DOCSEARCH_CONFIG", str(tmp_path / "c.yaml"))
    monkeypatch.setenv("DOCSEARCH_API_KEY", "your-api-key")
    import os

    assert load() == c and "DOCSEARCH_API_KEY" not in os.environ
    monkeypatch.delenv("DOCSEARCH_CONFIG")
    monkeypatch.chdir(tmp_path)
    assert load() == Config()


def test_model_rules():
    rules = ModelRules(retired=("old",), without_effort=("small",), without_temperature=("new",), with_fallback=("big",))
    faults = lambda **k: GenerationConfig(**({"temperature": None} | k), rules=rules).faults()
    assert faults(model="old-1") and faults(model="small-1", effort="low") and faults(model="new-1", temperature=0.0)
    assert not faults(model="big", enable_refusal_fallback=True, effort="max")


def test_env_file(tmp_path, monkeypatch):
    from docsearch.config import read_env

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / ".env").write_text("# note\nexport DS_A='x y'\nDS_B = \"q#1\"\nDS_C=plain # note\nDS_D=\nnot an entry\nDS_E=new\n")
    monkeypatch.setenv("DS_E", "old")
    for k in "ABCD":
        monkeypatch.setenv(f"DS_{k}", "")
        monkeypatch.delenv(f"DS_{k}")
    import os

    assert read_env(tmp_path / "a" / "b") == tmp_path / "a" / ".env"
    assert [os.environ[f"DS_{k}"] for k in "ABCDE"] == ["x y", "q#1", "plain", "", "old"]
    for k in "ABCD":
        del os.environ[f"DS_{k}"]

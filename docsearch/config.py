"""Settings: frozen groups, read from YAML, checked before anything runs."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

from docsearch.errors import ConfigError

MODES = ("off", "symbolic", "all")
EFFORTS = ("low", "medium", "high", "xhigh", "max")
CONFIG_VARIABLE, CONFIG_FILE, KEY_VARIABLE = "DOCSEARCH_CONFIG", "config.yaml", "DOCSEARCH_API_KEY"
#: Values of an API key that stand for none.
PLACEHOLDERS = ("", "your-api-key")


@dataclass(frozen=True)
class ParserConfig:
    large_pdf_page_threshold: int = 300
    large_pdf_size_mb: float = 50.0
    use_layout_parser: bool = True
    layout_timeout_sec: float = 600.0
    scanned_chars_per_page: int = 50
    preflight_sample_pages: int = 10
    min_layout_text_ratio: float = 0.5
    pdf_restore_heading_levels: bool = True
    pdf_inline_code_strip: str = "symbolic"
    excel_force_narrative: bool = False
    excel_max_header_rows: int = 3
    excel_include_hidden_sheets: bool = False


@dataclass(frozen=True)
class ChunkerConfig:
    headers_to_split_on: tuple[tuple[str, str], ...] = (("#", "h1"), ("##", "h2"), ("###", "h3"))
    parent_max_chars: int = 3000
    parent_min_chars: int = 800
    child_chunk_chars: int = 500
    child_overlap_chars: int = 50
    min_child_body_chars: int = 150
    min_child_chars: int = 10
    table_caption_max_chars: int = 150
    default_section: str = "본문"
    max_section_label_items: int = 3

    def faults(self) -> list[str]:
        rules = (
            (self.child_chunk_chars < self.parent_max_chars, "child_chunk_chars must be less than parent_max_chars"),
            (self.parent_min_chars <= self.parent_max_chars, "parent_min_chars must be parent_max_chars at most"),
            (self.child_overlap_chars < self.child_chunk_chars, "child_overlap_chars must be less than child_chunk_chars"),
        )
        return [f"chunker: {text}" for ok, text in rules if not ok]

    def check(self) -> None:
        if found := self.faults():
            raise ValueError("; ".join(found))


@dataclass(frozen=True)
class StoreConfig:
    persist_dir: str = "./store"
    collection_name: str = "children"
    embedding_model: str = "BAAI/bge-m3"
    embedding_device: str | None = None
    add_batch_size: int = 256


@dataclass(frozen=True)
class RetrieverConfig:
    dense_k: int = 20
    sparse_k: int = 20
    rrf_k: int = 60
    dense_weight: float = 0.5
    sparse_weight: float = 0.5
    top_n: int = 5
    reranker_model: str | None = None
    reranker_device: str | None = None
    rerank_candidates: int = 40
    reranker_max_length: int = 512
    rerank_min_score: float = 0.1

    def faults(self) -> list[str]:
        out = [f"retriever: {k} must be positive" for k in ("dense_k", "sparse_k", "top_n", "rrf_k", "rerank_candidates", "reranker_max_length") if getattr(self, k) <= 0]
        if not 0 <= self.rerank_min_score <= 1:
            out.append("retriever: rerank_min_score must be between 0 and 1")
        if min(self.dense_weight, self.sparse_weight) < 0 or self.dense_weight + self.sparse_weight == 0:
            out.append("retriever: weights can't be negative, nor both 0")
        return out


@dataclass(frozen=True)
class ModelRules:
    """What models refuse, by prefixes of their names; a deployment fills it in for the models that it uses."""

    retired: tuple[str, ...] = ()
    without_effort: tuple[str, ...] = ()
    without_temperature: tuple[str, ...] = ()
    with_fallback: tuple[str, ...] = ()


@dataclass(frozen=True)
class GenerationConfig:
    model: str = "default"
    effort: str | None = None
    temperature: float | None = 0.0
    max_tokens: int = 4096
    max_retries: int = 3
    timeout_sec: float = 120.0
    enable_refusal_fallback: bool = False
    max_context_chars: int = 24000
    rules: ModelRules = field(default_factory=ModelRules)

    def faults(self) -> list[str]:
        model, r, out = self.model.strip(), self.rules, []
        if self.max_tokens <= 0:
            out.append("max_tokens must be positive")
        if model.startswith(r.retired):
            out.append(f"{model!r} is out of service")
        if self.effort is not None and self.effort not in EFFORTS:
            out.append(f"effort must be one of {EFFORTS} or null")
        elif self.effort is not None and model.startswith(r.without_effort):
            out.append(f"{model!r} takes no effort: set it to null")
        if self.temperature is not None and not 0 <= self.temperature <= 1:
            out.append("temperature must be between 0 and 1")
        elif self.temperature is not None and model.startswith(r.without_temperature):
            out.append(f"{model!r} takes no temperature: set it to null")
        if self.enable_refusal_fallback and model not in r.with_fallback:
            out.append(f"{model!r} has no refusal fallback")
        return [f"generation: {x}" for x in out]


@dataclass(frozen=True)
class Config:
    parser: ParserConfig = field(default_factory=ParserConfig)
    chunker: ChunkerConfig = field(default_factory=ChunkerConfig)
    store: StoreConfig = field(default_factory=StoreConfig)
    retriever: RetrieverConfig = field(default_factory=RetrieverConfig)
    generation: GenerationConfig = field(default_factory=GenerationConfig)

    def validate(self) -> Config:
        found = [*self.chunker.faults(), *self.retriever.faults(), *self.generation.faults()]
        if self.parser.pdf_inline_code_strip not in MODES:
            found.append(f"parser: pdf_inline_code_strip must be one of {MODES}")
        if found:
            raise ConfigError("settings: " + "; ".join(found))
        return self

    @classmethod
    def from_yaml(cls, path: str | Path) -> Config:
        import yaml

        try:
            values = yaml.safe_load(Path(path).read_text("utf-8"))
        except (OSError, yaml.YAMLError) as e:
            raise ConfigError(f"can't read the settings: {e}", path) from e
        if values is not None and not isinstance(values, dict):
            raise ConfigError("the settings must be keys with values", path)
        return override(cls(), values or {}, path).validate()


def override(group: Any, values: dict, source: object = None, prefix: str = "") -> Any:
    """A group with some settings replaced; unknown keys are errors, whole numbers do for fractions."""
    names, new = {f.name for f in fields(group)}, {}
    for key, value in values.items():
        if key not in names:
            raise ConfigError(f"unknown setting {prefix}{key}; there are {', '.join(sorted(names))}", source)
        old = getattr(group, key)
        if is_dataclass(old):
            if not isinstance(value, dict):
                raise ConfigError(f"{prefix}{key} holds settings of its own", source)
            value = override(old, value, source, f"{prefix}{key}.")
        elif isinstance(old, tuple):
            value = tuple(tuple(x) if isinstance(x, list) else x for x in value)
        elif isinstance(old, float) and type(value) is int:
            value = float(value)
        new[key] = value
    return replace(group, **new)


_ENTRY = re.compile(r"""\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(?:'([^']*)'|"([^"]*)"|(.*?))\s*(?:\s#.*)?\Z""")


def read_env(folder: str | Path = ".") -> Path | None:
    """Sets what the nearest ``.env`` in a folder or above it says and the environment does not; returns its path."""
    here = Path(folder).resolve()
    found = next((f for f in (d / ".env" for d in (here, *here.parents)) if f.is_file()), None)
    for m in map(_ENTRY.match, found.read_text("utf-8").splitlines() if found else []):
        if m:
            os.environ.setdefault(m[1], next((x for x in m.groups()[1:] if x is not None), ""))
    return found


def load(path: str | Path | None = None) -> Config:
    """From the path given, else from the one that the environment names, else ./config.yaml, else the defaults; a ``.env`` is read first."""
    read_env()
    if os.environ.get(KEY_VARIABLE, "x").strip() in PLACEHOLDERS:
        del os.environ[KEY_VARIABLE]
    chosen = path or os.environ.get(CONFIG_VARIABLE) or (CONFIG_FILE if Path(CONFIG_FILE).exists() else None)
    return Config.from_yaml(chosen) if chosen else Config().validate()

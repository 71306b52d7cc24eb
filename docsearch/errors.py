"""Driver-side exceptions, and the names that row-level failures carry in ``error_type``."""

from __future__ import annotations


class DocsearchError(Exception):
    def __init__(self, message: str, source: object = None) -> None:
        super().__init__(f"{message} ({source})" if source else message)
        self.source = source


class ConfigError(DocsearchError):
    """A setting is unknown, out of range or does not fit another."""


class ParserError(DocsearchError):
    """A file can't be read."""


class UnsupportedFileError(ParserError):
    """Not a kind of file that is read, or not a file."""


class EncryptedDocumentError(ParserError):
    """A password is needed."""


class EmptyDocumentError(ParserError):
    """Nothing to read in it."""


class ChunkingError(DocsearchError):
    """No chunk comes out of a document."""


class IndexingError(DocsearchError):
    """The stored index can't be read or written."""


class IndexConfigMismatchError(IndexingError):
    """The index was built with another embedding model."""


class RetrievalError(DocsearchError):
    """Both searches failed."""


class GenerationError(DocsearchError):
    def __init__(self, message: str, retryable: bool = False) -> None:
        super().__init__(message)
        self.retryable = retryable


ROW_ERRORS = {c.__name__: c for c in (ParserError, UnsupportedFileError, EncryptedDocumentError, EmptyDocumentError, ChunkingError)}

"""Part of docsearch."""

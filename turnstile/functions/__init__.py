"""Column-level helpers: text classes, stripping, tokenizers."""

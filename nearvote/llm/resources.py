"""Places of the public tokenizers' vocabulary files (a parameter of every operator that needs one)."""

from __future__ import annotations


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN

"""Places of the public vocabulary files; a path given by the caller wins."""

from __future__ import annotations


def path(name: str, given: str | None = None) -> str:
    """The file of this name, on the machine that asks."""
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(name)

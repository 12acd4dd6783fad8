"""Word runs for the models, used inside tasks."""

from __future__ import annotations


class _Letters(dict):
    """Code point -> itself for a letter, a space for anything else; filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        c = self[code] = c if c.isalpha() else " "
        return c


_LETTERS = _Letters()


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, in order."""
    return text.lower().translate(_LETTERS).split() if text else []


class Bounded(dict):
    """A cache of ``make(key)`` that starts over when it holds ``limit`` entries."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._make(key)
        return value

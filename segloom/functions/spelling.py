"""Names compared despite case, spacing, punctuation and small misspellings."""

from __future__ import annotations

import unicodedata


def fold(text: str) -> str:
    """Letters and digits only, compatibility forms and case folded."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def edits(a: str, b: str, limit: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; limit + 1 if there are more.

    Only the cells within ``limit`` of the diagonal are computed.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    far = limit + 1
    before: list[int] = []
    row = [j if j <= limit else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        nxt = [far] * (len(b) + 1)
        if i <= limit:
            nxt[0] = i
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            y = b[j - 1]
            v = min(row[j - 1] + (x != y), row[j] + 1, nxt[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            nxt[j] = min(v, far)
        if min(nxt) > limit:
            return far
        before, row = row, nxt
    return row[len(b)]


class Vocabulary:
    """Maps spellings to canonical names; answers are remembered.

    A spelling means the entry it equals when folded, else the only nearest one within ``near`` edits (``long_near`` for
    folded entries of at least ``long`` characters). Others mean nothing in the vocabulary.
    """

    def __init__(self, entries: dict[str, str], near: int = 1, long_near: int = 2, long: int = 8):
        self.exact = {fold(k): v for k, v in entries.items() if k and v}
        self.near, self.long_near, self.long = near, long_near, long
        self.seen: dict[str, str | None] = {}

    def canonical(self, text: str) -> str | None:
        if text not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[text] = self._find(fold(text))
        return self.seen[text]

    def _find(self, folded: str) -> str | None:
        if folded in self.exact:
            return self.exact[folded]
        best, names = 99, set()
        for entry, name in self.exact.items():
            limit = self.long_near if len(entry) >= self.long else self.near
            n = edits(folded, entry, limit)
            if n <= limit and n <= best:
                names = {name} if n < best else names | {name}
                best = n
        return names.pop() if len(names) == 1 and len(folded) > 1 else None

"""Regular expressions that find many words in one pass over a text."""

from __future__ import annotations

from os.path import commonprefix

# Words nested deeper than this as prefixes of one another, or longer than this, fit no pattern.
MAX_PATTERNS = 6
MAX_WORD = 400
# So many of those are looked for one by one beside the patterns; with more of them, all words are left to the join.
MAX_SINGLE = 32
# Alternatives tried one after the other before a range test pays.
PARTS = 4


def search_patterns(words: set[str]) -> tuple[list[str], list[str]] | None:
    """(patterns, single words): the patterns' matches over all positions of a text are exactly the words inside it, but for the
    few that fit none and are returned as they are. None if those are too many.

    A look-ahead reports one word per position. Words that start with one another therefore go to different patterns:
    a word goes to the pattern numbered by how many other words in patterns are prefixes of it.
    """
    layers: list[list[str]] = []
    open_prefixes: list[str] = []
    single: list[str] = []
    for word in sorted(words):
        while open_prefixes and not word.startswith(open_prefixes[-1]):
            open_prefixes.pop()
        depth = len(open_prefixes)
        if depth >= MAX_PATTERNS or len(word) > MAX_WORD:
            single.append(word)
            continue
        if depth == len(layers):
            layers.append([])
        layers[depth].append(word)
        open_prefixes.append(word)
    if len(single) > MAX_SINGLE:
        return None
    return [f"(?=({_alternatives(layer)}))" for layer in layers], single


def _alternatives(words: list[str]) -> str:
    """Sorted words, none a prefix of another, as nested alternatives: shared beginnings are tested once."""
    shared = commonprefix([words[0], words[-1]])
    if len(words) == 1:
        return _literal(shared)
    branches: dict[str, list[str]] = {}
    for word in words:
        branches.setdefault(word[len(shared)], []).append(word[len(shared) :])
    return _literal(shared) + _choice([(first, _alternatives(rest)) for first, rest in branches.items()])


def _choice(branches: list[tuple[str, str]]) -> str:
    """Alternatives in order of their first character; long lists are cut in parts that a range test enters or skips."""
    if len(branches) <= PARTS:
        return "(?:" + "|".join(pattern for _, pattern in branches) + ")"
    size = -(-len(branches) // PARTS)
    parts = [branches[start : start + size] for start in range(0, len(branches), size)]
    return "(?:" + "|".join(f"(?=[{_literal(p[0][0])}-{_literal(p[-1][0])}]){_choice(p)}" for p in parts) + ")"


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)

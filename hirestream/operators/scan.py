"""One scan of a text for all terms, inside a task."""
from __future__ import annotations

import re
from collections.abc import Sequence
from operator import itemgetter

import numpy as np

#: Characters of terms of all pools that are sent to every task.
MAX_TERM_CHARS = 16 << 20
_BLANKS = str.maketrans(dict.fromkeys("\t\n\x0b\f\r", " "))
_SECOND = itemgetter(1)
_RUNS = re.compile(" {2,}")


def squeezed(text: str) -> str:
    """A text with its whitespace runs squeezed, as R4 does it."""
    text = text.translate(_BLANKS)
    return _RUNS.sub(" ", text) if "  " in text else text


class Terms:
    """``forms`` of each keyword as one Aho-Corasick automaton; blank ones are never found."""

    def __init__(self, forms: Sequence[Sequence[str | None]]):
        import ahocorasick
        holders: dict[str, list[int]] = {}
        for n, own in enumerate(forms):
            for t in dict.fromkeys(own):
                if t:
                    holders.setdefault(t, []).append(n)
        self.n, self.automaton = len(forms), ahocorasick.Automaton() if holders else None
        for k, t in enumerate(holders):
            self.automaton.add_word(t, k)
        if holders:
            self.automaton.make_automaton()
        # a term's first keyword, and the others of those few terms that have any
        self.first = np.array([who[0] for who in holders.values()], np.int64)
        self.others = {k: who[1:] for k, who in enumerate(holders.values()) if len(who) > 1}

    def bits(self, text: str | None) -> np.ndarray:
        """Which keywords a text contains."""
        out = np.zeros(self.n, bool)
        if self.automaton is not None and text:
            found = set(map(_SECOND, self.automaton.iter(text)))
            out[self.first[np.fromiter(found, np.int64, len(found))]] = True
            for k in self.others.keys() & found:
                out[self.others[k]] = True
        return out

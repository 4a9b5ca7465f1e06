"""Many needles in one walk of a text: an automaton over code points, with word bounds, denials and clauses.

The cost of a text is its length and what is found in it, however many needles there are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Mapping, Sequence

import ahocorasick

TOKEN = re.compile(r"[\w']+")
WORDLIKE = re.compile(r"[a-zà-öø-ÿ' \-]+")


def _word(letter: str) -> bool:
    return letter == "_" or letter.isalnum()


def _automaton(needles: Sequence[str]):
    made = ahocorasick.Automaton()
    for i, needle in enumerate(needles):
        made.add_word(needle, i)
    made.make_automaton()
    return made


class Needles:
    """Needles, all different and in lower case, none of them empty.

    A needle of letters counts within word bounds, any other anywhere. One that none of
    `denies` is part of doesn't count where one of the `reach` tokens before it in its
    clause denies it. `exclusions` of a needle are blanked first. `closures` don't count
    in a clause that names one of `services`. Clauses end at `ends`.
    """

    def __init__(self, needles: Sequence[str], denies: Callable[[str], bool], reach: int, ends: str,
                 exclusions: Mapping[str, Sequence[str]], closures: Sequence[str], services: Sequence[str]):
        self.needles, self.denies, self.reach, self.services = list(needles), denies, reach, frozenset(services)
        self.end = re.compile("[" + re.escape(ends) + "]")
        self.automaton = _automaton(self.needles) if self.needles else None
        self.bounded = [WORDLIKE.fullmatch(n) is not None for n in self.needles]
        self.sizes = [len(n) for n in self.needles]
        self.edges = [(_word(n[0]), _word(n[-1])) for n in self.needles]
        self.own_denial = [any(map(denies, TOKEN.findall(n))) for n in self.needles]
        self.closure = [n in closures for n in self.needles]
        self.exclusions = {i: exclusions[n] for i, n in enumerate(self.needles) if n in exclusions}

    def found(self, text: str) -> set[int]:
        """Places in `needles` of those that a text in lower case holds."""
        if not self.needles:
            return set()
        held = self._walk(text, self.automaton, self.exclusions)
        for i, phrases in self.exclusions.items():
            clean = text
            for phrase in phrases:
                clean = clean.replace(phrase, " ")
            one = ahocorasick.Automaton()
            one.add_word(self.needles[i], i)
            one.make_automaton()
            held |= self._walk(clean, one, ())
        return held

    def _walk(self, text: str, automaton, passed) -> set[int]:
        held: set[int] = set()
        ends: list[int] | None = None
        starts: list[int] | None = None
        spans: list[tuple[int, int]] = []
        bounded, sizes, edges, own_denial, closure, n = self.bounded, self.sizes, self.edges, self.own_denial, self.closure, len(text)
        for last, i in automaton.iter(text):
            if i in held or i in passed:
                continue
            after = last + 1
            begin = after - sizes[i]
            if bounded[i]:  # a word goes on behind it or before it
                first_word, last_word = edges[i]
                if (after < n and _word(text[after])) == last_word or (begin > 0 and _word(text[begin - 1])) == first_word:
                    continue
            if not own_denial[i] or closure[i]:
                if starts is None:  # once for a text, at its first needle
                    spans = [m.span() for m in TOKEN.finditer(text)]
                    starts = [s for s, _ in spans]
                behind = bisect_left(starts, begin)
                denied = [] if own_denial[i] else [s for s, e in spans[max(behind - self.reach, 0):behind] if self.denies(text[s:min(e, begin)])]
                if denied or closure[i]:  # few are, so clauses are looked for here
                    if ends is None:
                        ends = [m.start() for m in self.end.finditer(text)]
                    clause = ends[bisect_left(ends, begin) - 1] + 1 if ends and ends[0] < begin else 0
                    if any(s >= clause for s in denied):
                        continue
                    if closure[i]:
                        k = bisect_left(ends, begin)
                        until = ends[k] if k < len(ends) else n
                        within = spans[bisect_left(starts, clause):bisect_right(starts, until)]
                        if any(text[s:e] in self.services for s, e in within):
                            continue
            held.add(i)
        return held

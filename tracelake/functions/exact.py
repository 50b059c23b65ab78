"""Exact values found in texts by one automaton, in one pass over a text however many values there are.

Values come in groups (the rules that a finding is recorded under).  Where occurrences
overlap, those of an earlier group go first, then the longer value, then the smaller one,
then the one further left; so no longer value leaves a part of itself behind.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable

import ahocorasick

from tracelake.functions.rules import print_of


class Values:
    """An automaton over (group, value) pairs; what is shipped to executors.  A value of two groups belongs to the first."""

    def __init__(self, groups: dict[str, Iterable[str]]):
        self.names = list(groups)
        self.automaton = ahocorasick.Automaton()
        for number, values in enumerate(groups.values()):
            for value in values:
                if value and value not in self.automaton:
                    self.automaton.add_word(value, (number, value))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __bool__(self) -> bool:
        return len(self.automaton) > 0

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(number of the group, start, end) of every occurrence, overlapping ones too."""
        if not self:
            return []
        return [(group, end + 1 - len(value), end + 1) for end, (group, value) in self.automaton.iter(text)]


def chosen(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of all occurrences (group, start, end) in a text those that are replaced, by their start."""
    if len(found) > 1:
        found = sorted(found, key=lambda x: (x[0], x[1] - x[2], text[x[1] : x[2]], x[1]))
    taken: list[tuple[int, int, int]] = []  # (start, end, group), apart from one another
    for group, start, end in found:
        i = bisect_right(taken, (start, end, group))
        if (i and taken[i - 1][1] > start) or (i < len(taken) and taken[i][0] < end):
            continue
        insort(taken, (start, end, group))
    return [(group, start, end) for start, end, group in taken]


def replaced(text: str, spans: list[tuple[int, int, int]], names: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """A text with its spans (see chosen) replaced by marks, and (rule, fingerprint) of each, in order."""
    out, done, at = [], [], 0
    for group, start, end in spans:
        done.append((names[group], print_of(text[start:end])))
        out += [text[at:start], "[REDACTED:%s:%s]" % done[-1]]
        at = end
    return "".join([*out, text[at:]]), done

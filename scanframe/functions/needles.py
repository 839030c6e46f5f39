"""Which strings of a fixed set occur in a text, and which expressions that leaves possible."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACES = pa.list_(pa.int32())
# Letters that a case-blind expression equates with i and s although lower() does not; the
# first one is what lower() leaves behind the i of a dotted capital.
_ODD = ("\u0307", "\u0131", "\u017f")


def _finder(strings: list[str]):
    """Function from a text to the set of the strings in it."""
    if not strings or "" in strings:  # the empty string is in every text, and no automaton holds it
        return lambda t: {s for s in strings if s in t}
    automaton = ahocorasick.Automaton()
    for s in strings:
        automaton.add_word(s, s)
    automaton.make_automaton()
    return lambda t: {s for _, s in automaton.iter(t)}


def searcher(literals: list[str], needs: list):
    """Function from a lower-case text to two sorted place lists, see ``prefilter``."""
    strings = list(dict.fromkeys([*literals, *(n for entry in needs for alternatives in entry for n in alternatives)]))
    places: dict[str, list[int]] = {}
    for i, s in enumerate(literals):
        places.setdefault(s, []).append(i)
    # an entry is looked at when a string of its first list occurs
    first: dict[str, list[int]] = {}
    for i, entry in enumerate(needs):
        for s in set(entry[0]) if entry else ():
            first.setdefault(s, []).append(i)
    others = [[frozenset(alternatives) for alternatives in entry[1:]] for entry in needs]
    every = list(range(len(needs)))
    free = [i for i in every if not needs[i]]
    find = _finder(strings)

    def search(t: str) -> tuple[list[int], list[int]]:
        present = find(t)
        found = sorted(i for s in present for i in places.get(s, ()))
        if not t.isascii() and any(c in t for c in _ODD):
            return found, every
        begun = {*free, *(i for s in present for i in first.get(s, ()))}
        return found, sorted(i for i in begun if not any(present.isdisjoint(alts) for alts in others[i]))

    return search


def prefilter(lowered: Column, literals: list[str], needs: list) -> Column:
    """Struct of two sorted place lists for a lower-case text, empty ones for null.

    ``literals``: strings that occur. ``regexes``: entries of ``needs`` that are met, where an
    entry lists alternatives lists and each of those must have a member in the text.

    Evaluated in Arrow batches, with one automaton for all strings: measured on 10 MB of prose and
    166 strings it takes 0.39 s, one search per string and text 1.44 s, one Arrow kernel call per
    string and batch 6.7 s.
    """

    @F.arrow_udf("literals array<int>, regexes array<int>")
    def search(texts: pa.Array) -> pa.Array:
        find = searcher(literals, needs)
        pairs = [([], []) if t is None else find(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([p[k] for p in pairs], _PLACES) for k in (0, 1)], ["literals", "regexes"])

    return search(lowered)

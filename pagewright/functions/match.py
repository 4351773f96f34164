"""Many patterns in a text at once: an Aho-Corasick automaton in one Arrow stage, whatever the number of patterns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_terms(low: Column, terms: tuple[tuple[str, str], ...], limit: int) -> Column:
    """Terms (term, kind) of a text in lower case, as structs of at (from 1), term and kind, in the order in which they stand.

    A term is looked for at its first place that no letter or hyphen flanks; of terms within a character of each other the
    one that comes first in `terms` counts. At most `limit`, the first ones. A null text has none.
    """

    def find(texts: pa.Array) -> pa.Array:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, (term, _) in enumerate(terms):
            automaton.add_word(term, (k, len(term)))
        automaton.make_automaton()
        out = []
        for text in texts.to_pylist():
            first: dict[int, int] = {}
            for end, (k, n) in automaton.iter(text or ""):
                if k in first:
                    continue
                at = end + 1 - n
                flanks = text[at - 1 : at] + text[end + 1 : end + 2] if at else text[end + 1 : end + 2]
                if not any(c == "-" or c.isalpha() for c in flanks):
                    first[k] = at
            kept: list[tuple[int, int]] = []
            for k in sorted(first):
                if all(abs(at - first[k]) > 1 for at, _ in kept):
                    kept.append((first[k], k))
            out.append([{"at": at + 1, "term": terms[k][0], "kind": terms[k][1]} for at, k in sorted(kept)[:limit]])
        return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("term", pa.string()), ("kind", pa.string())])))

    return F.arrow_udf(find, "array<struct<at:int,term:string,kind:string>>").asNondeterministic()(low)  # evaluated once, though filters and columns name it


def group_hits(low: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """For each group of patterns that a text in lower case has one of: its number and how many different ones, as structs of
    grp and hits. Patterns are found anywhere, also within words. A null text has none."""

    def find(texts: pa.Array) -> pa.Array:
        import ahocorasick

        of: dict[str, list[int]] = {}
        for g, patterns in enumerate(groups):
            for p in dict.fromkeys(patterns):
                of.setdefault(p, []).append(g)
        automaton = ahocorasick.Automaton()
        for p in of:
            automaton.add_word(p, p)
        automaton.make_automaton()
        out = []
        for text in texts.to_pylist():
            hits: dict[int, int] = {}
            for p in {p for _, p in automaton.iter(text or "")}:
                for g in of[p]:
                    hits[g] = hits.get(g, 0) + 1
            out.append([{"grp": g, "hits": n} for g, n in sorted(hits.items())])
        return pa.array(out, pa.list_(pa.struct([("grp", pa.int32()), ("hits", pa.int32())])))

    return F.arrow_udf(find, "array<struct<grp:int,hits:int>>").asNondeterministic()(low)

"""Text functions as Column expressions.

Lengths count code points. Word boundaries are ASCII, as the rules are written for.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import rules

from .match import whole_terms

EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
STEM = r"(ing|ed|es|s)$"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'-]*"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it: what is written out again and again in an expression
    is planned and evaluated as often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bounded(pattern: str) -> str:
    r"""A case-insensitive pattern in which \b is an ASCII word boundary; before a digit, one that is looked for at digits only."""
    return "(?i)" + re.sub(r"\\b(?=\\d(?![?*{]))", lambda _: r"(?=\d)(?<![A-Za-z0-9_])", pattern).replace(r"\b", EDGE)


def alternatives_of(pattern: str) -> list[str]:
    """The alternatives of a pattern's outermost level."""
    out, depth, kind, k = [""], 0, False, 0
    while k < len(pattern):
        c = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        kind = c == "[" or (kind and c != "]")
        depth += 0 if kind else (c == "(") - (c == ")")
        if c == "|" and not depth and not kind:
            out.append("")
        else:
            out[-1] += c
        k += len(c)
    return out


def whole_words(alternatives: str) -> str:
    """A case-insensitive pattern of the alternatives between ASCII word boundaries.

    Alternatives that begin with a plain letter or digit stand under it, and are tried only where one of these begins a word; a
    boundary that is looked for at each character, and each alternative after it, takes many times as long."""
    by: dict[str, list[str]] = {}
    for a in alternatives_of(alternatives):
        first = re.match(r"[A-Za-z0-9](?![?*+{])", a)
        by.setdefault(first[0].lower() if first else "", []).append(a)
    others = "|".join(by.pop("", []))
    words = "|".join(f"{c}(?:{'|'.join(a[1:] for a in some)})" for c, some in by.items())
    sign = "(?=#)" if others and all(a.startswith("#") for a in alternatives_of(others)) else ""
    tried = [f"(?=[{''.join(by)}])(?<![A-Za-z0-9_])(?:{words})"] * bool(by) + [f"{sign}{EDGE}(?:{others})"] * bool(others)
    return f"(?i)(?:{'|'.join(tried)}){EDGE}"


def collapse(s: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s{2,}|[^\S ]", " "))  # single spaces stay as they are


def words(s: Column) -> Column:
    return F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))


def sentences(s: Column) -> Column:
    """Pieces between white space that follows `.`, `!` or `?`; blank ones are left out."""
    pieces = F.transform(F.split(s, r"(?<=[.!?])\s+"), lambda x: F.trim(x))  # trim itself would be handed the place, too, and take it off as characters
    return F.filter(pieces, lambda x: x != "")


def tokens(s: Column) -> Column:
    """Words in lower case."""
    return F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0))


def stem(w: Column) -> Column:
    return F.regexp_replace(w, STEM, "")


def estimated_tokens(s: Column) -> Column:
    return F.ceil(F.length(s) / 3.5).cast("long")


def is_question(s: Column) -> Column:
    return F.contains(s, F.lit("?")) | F.trim(s).rlike(f"(?i)^(?:{'|'.join(rules.QUESTION_WORDS)}){EDGE}")


def is_promissory(heading: Column) -> Column:
    """Whether a heading makes a promise: a question, or a topic of two words and more that isn't a name."""
    t = F.trim(heading)
    n = F.size(F.split(t, r"\s+"))
    name = (n <= 3) & t.rlike(r"^[A-Z][a-z]+(\s[A-Z][a-z]+){1,2}$")
    return F.coalesce((F.length(t) >= 4) & (F.contains(t, F.lit("?")) | ((n >= 2) & ~name)), F.lit(False))


def is_name_like(heading: Column) -> Column:
    """Whether a heading reads as a person's or product's name; no heading counts as one."""
    t = F.trim(F.regexp_replace(heading, "[￼​]", ""))
    name = t.rlike(r"^\p{L}[\p{L}\p{N}'’._\-]*(\s+\p{L}[\p{L}\p{N}'’._\-]*){0,3}$")
    return F.when(F.coalesce(heading, F.lit("")) == "", True).otherwise((t != "") & ~F.contains(t, F.lit("?")) & ~t.rlike(whole_words(rules.TOPIC_WORDS)) & name)


def language_supported(lang: Column) -> Column:
    low = F.lower(F.coalesce(lang, F.lit("")))
    return (low == "") | (low == "en") | low.startswith("en-")


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as 8 hex digits."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("(.{4})")), lambda c: F.conv(c, 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(0x01000193).cast("long"), F.lit(1 << 32).cast("long")))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def filled(template: Column, slots: Column) -> Column:
    """The template with each {slot} that the map has replaced; others stay as they are."""
    return F.aggregate(F.map_entries(slots), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def redacted(s: Column) -> Column:
    """Credentials in messages replaced by a marker."""
    s = F.regexp_replace(s, bounded(r"\bBearer\s+[A-Za-z0-9._\-]{16,}"), "Bearer [redacted]")
    s = F.regexp_replace(s, bounded(r"\b(sk|key|tok)[-_][A-Za-z0-9._\-]{16,}"), "[redacted]")
    return F.regexp_replace(s, r"(?i)([?&](?:api[-_]?key|key|token)=)[^&\s]+", "$1[redacted]")


def claim_kind(s: Column, claims=rules.CLAIMS) -> Column:
    """The first family whose words the text has, else null: all families' words are looked for at once, then, in a text that has
    some, each family's."""
    out = F.lit(None).cast("string")
    for kind, pattern, _ in reversed(claims):
        out = F.when(s.rlike(whole_words(pattern)), kind).otherwise(out)
    return F.when(s.rlike(whole_words("|".join(p for _, p, _ in claims))), out)


def claim_subject(kind: Column, claims=rules.CLAIMS) -> Column:
    return F.coalesce(*[F.when(kind == k, what) for k, _, what in claims])


def evidence_kinds(s: Column, evidence=rules.EVIDENCE) -> Column:
    """All kinds of evidence in the text, in their order."""

    def pattern(p: str) -> str:
        words = re.fullmatch(r"\\b\((?!\?)((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)\\b", p)  # a group between two boundaries
        return whole_words(words[1]) if words else bounded(p)

    return F.filter(F.array(*[F.when(s.rlike(pattern(p)), k) for k, p in evidence]), lambda k: k.isNotNull())


def hype_density(s: Column, terms: list[tuple[str, str]] | None = None) -> Column:
    """Terms of the lexicon a hundred words."""
    return F.lit(100.0) * F.size(hype_terms(s, terms, 100)) / words(s)


def highlighted(s: Column, terms: tuple[str, ...]) -> Column:
    """The text with each of the terms marked that no letter or hyphen stands next to, in any case (A-Z)."""
    every = "|".join(map(re.escape, sorted(terms, key=len, reverse=True)))
    return F.regexp_replace(s, rf"(?i)(?<![\p{{L}}-])({every})(?![\p{{L}}-])", "<mark>$1</mark>")


def hype_terms(s: Column, terms: list[tuple[str, str]] | None = None, limit: int = 6) -> Column:
    """Terms of the lexicon in the order in which they stand, as structs of at (from 1), term and kind: longer ones first where
    they meet; see match.whole_terms()."""
    return whole_terms(F.lower(s), tuple(rules.hype() if terms is None else terms), limit)


def quote(s: Column, most: int = 240) -> Column:
    """The text, or its beginning with an ellipsis."""
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most)), F.lit("…"))).otherwise(s)


def is_quoted(text: Column, said: Column) -> Column:
    """Whether the quote, without a closing ellipsis, is a part of the text; white space runs are alike."""
    return F.contains(collapse(text), collapse(F.regexp_replace(said, "…$", "")))


def needed_confidence(kind: Column, options: Column, bar: float = 0.6) -> Column:
    """The confidence that an answer needs: by kind, and for choices by the number of options."""
    choice = F.when(options <= 2, F.lit(0.6)).otherwise(F.greatest(F.lit(0.35), F.least(F.lit(0.6), F.lit(2.0) / options)))
    return F.when(kind == "choice", choice).when(kind == "score", F.least(F.lit(0.5), F.lit(bar))).otherwise(F.lit(bar))


def answer_confidence(confidence: Column, noul: Column) -> Column:
    """The stated confidence, else for yes/no answers their distance from the middle, else 0."""
    return F.coalesce(confidence, F.when(noul.isNotNull(), F.least(F.lit(1.0), F.abs(noul - 0.5) * 2)), F.lit(0.0))  # least() passes over nulls


def banded(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.65, "medium").otherwise("low")


def page_band(confidence: Column) -> Column:
    """The band of an answer about a whole page that passed the gate: high or medium."""
    return F.when(confidence >= 0.85, "high").otherwise("medium")


def tier(check: Column) -> Column:
    """Impact tier of a check; 4 where none is given."""
    out = F.lit(4)
    for t in range(4):
        ids = [c[0] for c in rules.CHECKS if c[3] == t]
        out = F.when(check.isin(*ids), t).otherwise(out)
    return out

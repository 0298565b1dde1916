"""Counting lexicon terms.

A term of Latin letters, digits, spaces and `.+-` is counted between non-alphanumerics, any other as a substring. A text is scanned once for the terms of all
lists: a pattern that only looks ahead captures the term that starts at each place, and terms that can start at one place are kept in patterns of their own. A
list's count is then the number of captured terms in it, so more lists cost no more scans.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

def latin(term: str) -> bool:
    return bool(re.fullmatch(r"[a-z0-9][a-z0-9 .+\-]{0,64}", term)) and any(c.isalpha() for c in term)


def count(text: Column, term: str) -> Column:
    """Occurrences of one term in a normalized text."""
    t = term.lower()
    if latin(t):
        word = max(re.split(r"[ ]", t), key=len)
        pattern = r"(?<![a-z0-9])" + re.sub(r"([.+\-])", r"\\\1", t).replace(" ", r"\s+") + r"(?![a-z0-9])"
        return F.when(F.contains(text, F.lit(word)), F.regexp_count(text, F.lit(pattern))).otherwise(0)
    return F.when(F.contains(text, F.lit(t)), ((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("int")).otherwise(0)


def balanced_sum(parts: list[Column]) -> Column:
    if not parts:
        return F.lit(0)
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _clash(a: str, b: str) -> bool:
    """Whether two terms can start at one place."""
    a, b = sorted((a, b), key=len)
    return b.startswith(a) and (not latin(a) or len(a) == len(b) or not re.match(r"[a-z0-9]", b[len(a)]))


def _overlaps_itself(term: str) -> bool:
    """Whether two occurrences can share characters; those of a Latin term only where it has a boundary."""
    inside = lambda k: latin(term) and (term[k].isalnum() or term[-k - 1].isalnum())
    return any(term[:k] == term[-k:] and not inside(k) for k in range(1, len(term)))


def groups(terms: list[str]) -> list[list[str]]:
    """Terms of one kind in as few lists as come, such that no two of a list can start at one place."""
    out: list[list[str]] = []
    for t in sorted(terms, key=len):
        for group in out:
            if not any(_clash(t, other) for other in group):
                group.append(t)
                break
        else:
            out.append([t])
    return out


def _alternatives(terms: list[str]) -> str:
    """One pattern for all, branching by the first character."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[0], []).append(t[1:])
    quoted = lambda t: re.sub(r"([^\w ])", r"\\\1", t)
    return "|".join(quoted(c) + "(?:" + "|".join(map(quoted, rest)) + ")" for c, rest in by.items())


def matches(text: Column, vocabulary: list[str]) -> Column:
    """Every occurrence of every term in a normalized text, as an array of terms; non-overlapping occurrences of each term, as if it were sought alone."""
    low = sorted({t.lower() for t in vocabulary if t})
    alone = [t for t in low if _overlaps_itself(t)]
    words = [t for t in low if latin(t) and t not in alone]
    others = [t for t in low if not latin(t)]
    arabic = [t for t in others if t not in alone and re.search("[\u0600-\u06ff]", t)]
    rest = [t for t in others if t not in alone and t not in arabic]
    none = F.array().cast("array<string>")
    seek = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    found = [seek(rf"(?<![a-z0-9])(?=({_alternatives(g)})(?![a-z0-9]))") for g in groups(words)]
    found += [seek(f"(?=({_alternatives(g)}))") for g in groups(rest)]
    if arabic:
        found.append(F.when(text.rlike(r"[\u0600-\u06ff]"), F.concat(*[seek(f"(?=({_alternatives(g)}))") for g in groups(arabic)])).otherwise(none))
    found += [F.array_repeat(F.lit(t), count(text, t)) for t in alone]
    return F.concat(none, *found)


def literals(words: list[str]) -> Column:
    """A constant array, made by one call however long it is."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"cast(array({quoted}) as array<string>)")


def _member(words: list[str]):
    listed = literals(words)
    return lambda m: F.array_contains(listed, m)


def tally(found: Column, terms: list[str]) -> Column:
    """How often the terms of a bag are among the matches; a term that stands twice in the bag counts twice."""
    left, parts = [t.lower() for t in terms if t], []
    while left:
        once = list(dict.fromkeys(left))
        parts.append(F.size(F.filter(found, _member(once))))
        for t in once:
            left.remove(t)
    return balanced_sum(parts)


def total(text: Column, terms: list[str]) -> Column:
    """Occurrences of all terms of a bag in a normalized text."""
    return tally(matches(text, terms), terms)


def some_of(text: Column, terms: list[str], least: int = 1) -> Column:
    """1.0 where at least `least` entries are substrings, else 0.0."""
    entries = [t.lower() for t in terms if t]
    if least == 1:
        hit = F.exists(literals(entries), lambda t: F.contains(text, t))
    else:
        hit = F.size(F.filter(literals(entries), lambda t: F.contains(text, t))) >= least
    return F.when(hit, 1.0).otherwise(0.0)

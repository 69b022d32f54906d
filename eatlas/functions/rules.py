"""Ordered pattern rules compiled to one Column."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bound

_WORD = "[0-9A-Za-z_]"
_ASCII_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def java_regex(pattern: str) -> str:
    """Java form of a rule pattern.

    Java treats Hangul as word characters at ``\\b`` and knows only ASCII
    blanks in ``\\s``; the rules mean ASCII words and all Unicode blanks.
    """
    return "(?i)" + pattern.replace(r"\b", _ASCII_BOUNDARY).replace(r"\s", SPACE)


# An escape, a class, a group's ends, or any other character of a rule pattern.
_PIECE = re.compile(r"\\.|\[(?:\\.|[^]\\])*\]|.", re.DOTALL)


def _terms(pattern: str) -> Iterator[tuple[str, str]]:
    """Terms of a rule pattern at its top level, groups whole, each with its quantifier."""
    pieces, i = _PIECE.findall(pattern), 0
    while i < len(pieces):
        start, depth = i, 0
        while True:
            depth += (pieces[i] == "(") - (pieces[i] == ")")
            i += 1
            if not depth:
                break
        term, quantifier = "".join(pieces[start:i]), ""
        while i < len(pieces) and (pieces[i] in "?*+{" or quantifier.startswith("{") and not quantifier.endswith("}")):
            quantifier += pieces[i]
            i += 1
        yield term, quantifier


def _alternatives(pattern: str) -> list[str]:
    parts = [""]
    for term, quantifier in _terms(pattern):
        if term == "|":
            parts.append("")
        else:
            parts[-1] += term + quantifier
    return parts


def _is_plain(term: str) -> bool:
    return len(term) == 1 and term not in "^$."


def _has_case(word: str) -> bool:
    return re.search("[A-Za-z]", word) is not None


def _needed(alternative: str) -> list[str] | None:
    """Words of which each text that the alternative matches holds one, None if there are no such words."""
    runs, groups = [""], []
    for term, quantifier in _terms(alternative):
        always = quantifier in ("", "+")
        if _is_plain(term) and always:
            runs[-1] += term
        elif term.startswith("(?:") and always:
            groups.append([_needed(part) for part in _alternatives(term[3:-1])])
        if not _is_plain(term) or quantifier:
            runs.append("")
    longest = max(runs, key=lambda run: (bool(run), not _has_case(run), len(run)))
    if longest:
        return [longest]
    for words in groups:
        if all(words):
            return [word for some in words for word in some]
    return None


@functools.cache
def _split(pattern: str) -> tuple[list[str], str, list[str] | None]:
    """Words that match by themselves, a pattern of the other alternatives, and words of which that one needs one."""
    parts = _alternatives(pattern)
    is_word = lambda part: part and not _has_case(part) and all(_is_plain(t) and not q for t, q in _terms(part))
    rest = [part for part in parts if not is_word(part)]
    needed = [_needed(part) for part in rest]
    guards = [*dict.fromkeys(word for some in needed for word in some)] if all(needed) else None
    return [part for part in parts if is_word(part)], "|".join(rest), guards


def _has_any(text: Column, words: Sequence[str]) -> Column:
    if len(words) == 1:
        return text.contains(words[0])
    return F.exists(F.array(*[F.lit(word) for word in words]), lambda word: F.contains(text, word))


def matches(text: Column, pattern: str) -> Column:
    """Does the rule pattern match somewhere in the text?

    Alternatives that are plain words are looked up as words, and the regular
    expression of the others runs only on texts that hold a word it needs: a
    list of words is far slower as a regular expression.
    """
    words, rest, guards = _split(pattern)

    def found(value: Column) -> Column:
        tests = [_has_any(value, words)] if words else []
        if rest:
            test = value.rlike(java_regex(rest))
            if guards is not None:
                cased = [word.lower() for word in guards if _has_case(word)]
                exact = [word for word in guards if not _has_case(word)]
                held = [_has_any(value, exact)] if exact else []
                if cased:
                    held.append(bound(F.lower(value), lambda lowered: _has_any(lowered, cased)))
                test = functools.reduce(lambda a, b: a | b, held) & test
            tests.append(test)
        return functools.reduce(lambda a, b: a | b, tests)

    return F.coalesce(bound(text, found), F.lit(False))


def first_match(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first rule that matches, NULL when none does."""
    chain = None
    for label, pattern in rules:
        hit = matches(text, pattern)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def first_evidence(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The words the winning rule matched on, NULL when none matches."""
    chain = None
    for _, pattern in rules:
        hit = matches(text, pattern)
        words = F.regexp_extract(text, java_regex(pattern), 0)
        chain = F.when(hit, words) if chain is None else chain.when(hit, words)
    return chain

"""Column functions on text: cleaning, tokens, entities, target identity."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists that decide which tokens and entities there are.
TOKEN = "[a-z0-9]+(?:-[a-z0-9]+)?"
ALNUM = "[a-z0-9]+"
ENTITY = r"\b(?:[A-Z][A-Za-z0-9]*(?:-[A-Z][A-Za-z0-9]+)+|[A-Z]{2,10}|[A-Z][a-z]+(?:\s+[A-Z][A-Za-z-]+){1,3})\b"
STOP_ENTITIES = ("abstract", "introduction", "related work", "large language models", "retrieval augmented generation")
ENTITY_LIMIT = 20
#: What counts as white space: the Unicode property and four separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


#: Letters that got a lower case after Unicode 13, which a JVM may not know yet. Code points, ends included.
LATE = ((0x1C89, 0x1C89), (0x2C2F, 0x2C2F), (0xA7C0, 0xA7C0), (0xA7CB, 0xA7DC), (0x10570, 0x10595), (0x10D50, 0x10D65))


@functools.cache
def folds() -> dict[str, str]:
    """The characters whose full case folding isn't reached by lower case, with their folding."""
    late = {c for first, last in LATE for c in range(first, last + 1)}
    return {x: x.casefold() for c in range(sys.maxunicode + 1) if (x := chr(c)).casefold() != x and (x.lower() == x or c in late)}


def ranges(characters: Iterable[str], gap: int = 16) -> str:
    """A class of the characters and what lies between near ones: matching costs by its parts."""
    parts: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if parts and c - parts[-1][1] <= gap:
            parts[-1][1] = c
        else:
            parts.append([c, c])
    return "[" + "".join(rf"\x{{{first:X}}}-\x{{{last:X}}}" for first, last in parts) + "]"


def casefold(text: Column) -> Column:
    """Full case folding: lower case, then what folds() says. All but sharp s is looked for only in texts that may hold any: those
    with a character beyond the western European ones, and of these those with one in certain ranges."""
    low = F.lower(text)
    one = {c: f for c, f in folds().items() if len(f) == 1}
    # one literal, as this expression is in many places of a plan: each character before what it becomes
    several = F.split(F.lit(" ".join(c + f for c, f in folds().items() if len(f) > 1)), " ")
    rare = F.aggregate(several, F.translate(low, "".join(one), "".join(one.values())), lambda t, x: F.replace(t, F.left(x, F.lit(1)), F.substring(x, 2, 9)))
    own = [c for c in folds() if c != "ß"]
    beyond = rf"[µ\x{{{ord(min(c for c in own if c != 'µ')):X}}}-\x{{10FFFF}}]"
    some = F.octet_length(low) > F.char_length(low)  # no need to look for them in ASCII
    return F.when(some & F.rlike(low, F.lit(beyond)) & F.rlike(low, F.lit(ranges(own))), rare).otherwise(F.replace(low, F.lit("ß"), F.lit("ss")))


def tokens(text: Column) -> Column:
    """Alphanumeric runs with at most one hyphen joint, in order, repeats included."""
    return F.regexp_extract_all(casefold(text), F.lit(TOKEN), F.lit(0))


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings or binaries, nulls as empty ones, and where each begins and the last ends."""
    values = values.cast(pa.binary()).fill_null(b"")
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def token_lists(texts: pa.Array) -> pa.ListArray:
    """tokens() of texts, worked out on all their bytes at once. What folds into a letter or digit of a token is the same for Java and Python."""
    data, ends = flat_bytes(pa.array([(t or b"").decode(errors="replace").casefold() for t in texts.cast(pa.binary()).to_pylist()], pa.string()))
    alnum = (data - np.uint8(ord("a")) < 26) | (data - np.uint8(ord("0")) < 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(alnum & (edge[:-1] | ~np.concatenate(([False], alnum[:-1]))))
    stops = np.flatnonzero(alnum & (edge[1:] | ~np.concatenate((alnum[1:], [False])))) + 1
    own = np.searchsorted(ends, starts, "right") - 1
    # of runs that single hyphens join, the first takes the second, the third the fourth
    joint = np.zeros(len(starts), bool)
    joint[:-1] = (stops[:-1] + 1 == starts[1:]) & (own[:-1] == own[1:])
    joint[joint] = data[stops[joint]] == ord("-")
    place = np.arange(len(starts))
    alone = ~np.concatenate(([False], joint[:-1]))[: len(starts)]
    first = (place - np.maximum.accumulate(np.where(alone, place, 0))) % 2 == 0
    joint &= first
    stop = stops.copy()
    stop[joint] = stops[np.flatnonzero(joint) + 1]
    alnum[stops[joint]] = True
    size = np.concatenate(([0], np.cumsum((stop - starts)[first]))).astype(np.int32)
    words = pa.StringArray.from_buffers(int(first.sum()), pa.py_buffer(size), pa.py_buffer(data[alnum]))
    many = np.bincount(own[first], minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), words)


def normalize_entity(name: Column) -> Column:
    return clean_text(casefold(name))


def word_form(name: Column) -> Column:
    """Alphanumeric runs joined by spaces. Names of equal normal form have equal word forms."""
    return F.array_join(F.regexp_extract_all(normalize_entity(name), F.lit(ALNUM), F.lit(0)), " ")


def compact_form(name: Column) -> Column:
    return F.replace(word_form(name), F.lit(" "), F.lit(""))


def entities(text: Column, limit: int = ENTITY_LIMIT) -> Column:
    """Normalised entities in order of first occurrence; stop entities and repeats don't use up the limit."""
    # each begins with a capital: looking for that first is cheaper than for a Unicode word's edge
    found = F.transform(F.regexp_extract_all(text, F.lit("(?U)(?=[A-Z])" + ENTITY), F.lit(0)), lambda e: clean_text(F.lower(F.btrim(e, F.lit(" ,.;:()[]")))))  # they are ASCII
    return F.slice(F.array_distinct(F.filter(found, lambda e: ~e.isin(*STOP_ENTITIES))), 1, limit)


def target_pattern(target: Column) -> Column:
    """A regular expression for the target's words as a whole name; null if it has none."""
    words = F.regexp_extract_all(casefold(target), F.lit(ALNUM), F.lit(0))
    return F.when(F.size(words) > 0, F.concat(F.lit("(?<![a-z0-9-])"), F.array_join(words, r"[\s-]+"), F.lit("(?![a-z0-9-])")))


def target_matches(target: Column, text: Column) -> Column:
    """Whether the text names the target itself: no part of a longer hyphenated name counts."""
    return F.coalesce(F.rlike(casefold(text), target_pattern(target)), F.lit(False))


def unique_strings(values: Column, limit: int) -> Column:
    """Trimmed, non-blank, first of equals (case matters), at most limit. values: array of strings, nulls dropped."""
    trimmed = F.transform(values, lambda v: F.regexp_replace(v, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda v: v != "")), 1, limit)

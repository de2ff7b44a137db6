"""Column expressions over sequences: any alphabet, A C G T N where it matters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus of the hash family of signatures: 2^31 - 1.
PRIME = 2147483647


def clean(seq: Column, *, upper: bool = True, degenerate: bool = True, gaps: bool = True) -> Column:
    """Upper-case, degenerate bases as N, gaps removed."""
    out = F.upper(seq) if upper else seq
    if degenerate:
        out = F.translate(out, "YRWSMKBDHV", "NNNNNNNNNN")
    return F.replace(out, F.lit("-"), F.lit("")) if gaps else out


def dna_of_text(text: Column) -> Column:
    """Text as a sequence over A C G T N: letters by alphabet position, ends of sentences as NN, anything else N."""
    t = F.regexp_replace(F.replace(F.replace(F.lower(text), F.lit(". "), F.lit("##")), F.lit(" "), F.lit("")), "[^a-z]", "N")
    return F.translate(t, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def unambiguous_length(seq: Column) -> Column:
    return F.char_length(F.regexp_replace(seq, "[^ACGT]", ""))


def identifier(seq: Column) -> Column:
    """Last ten hexadecimal digits of SHA-224."""
    return F.right(F.sha2(seq, 224), F.lit(10))


def chars(seq: Column) -> Column:
    return F.split(seq, "")


def mismatches(a: Column, b: Column) -> Column:
    """Positions at which equally long sequences differ; null if their lengths differ."""
    differ = F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: x != y), lambda z: z))
    return F.when(a == b, F.lit(0)).when(F.char_length(a) == F.char_length(b), differ)


def mismatches_at(a: Column, b: Column, offset: int) -> Column:
    """Mismatches over the overlap when b is moved right by offset."""
    k, n = abs(offset), F.char_length(a)
    ahead, behind = F.substring(a, F.lit(k + 1), n - k), F.substring(b, F.lit(1), n - k)
    if offset < 0:
        ahead, behind = F.substring(b, F.lit(k + 1), n - k), F.substring(a, F.lit(1), n - k)
    return mismatches(ahead, behind)


def least_mismatches(a: Column, b: Column, shift: int) -> Column:
    """Fewest mismatches over all offsets from -shift to shift."""
    return F.least(*[mismatches_at(a, b, o) for o in range(-shift, shift + 1)]) if shift else mismatches(a, b)


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k in order; empty if the sequence is shorter."""
    n = F.char_length(seq)
    at = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(n >= k, at).otherwise(F.array().cast("array<string>"))


def blocks(seq: Column, k: int) -> Column:
    """Non-overlapping substrings of length k."""
    n = F.char_length(seq)
    at = F.transform(F.sequence(F.lit(1), n - k + 1, F.lit(k)), lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(n >= k, at).otherwise(F.array().cast("array<string>"))


def jaccard_distance(a: Column, b: Column, k: int) -> Column:
    """One less the share of common distinct k-mers."""
    x, y = kmers(a, k), kmers(b, k)
    return 1 - F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def word_number(word: Column) -> Column:
    """The first 32 bits of a word's MD5 as a number."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint")


def word_hashes(words: Column, a: int, b: int) -> Column:
    """(a x + b) mod PRIME of each word's number x; a and b are below 2^31."""
    return F.transform(words, lambda w: (F.lit(a).cast("bigint") * word_number(w) + F.lit(b)) % PRIME)  # below 2^63


def smallest(hashes: Column, n: int) -> Column:
    """The n smallest of an array, which is repeated if it has fewer."""
    times = F.ceil(F.lit(n) / F.greatest(F.size(hashes), F.lit(1))).cast("int")
    return F.slice(F.array_sort(F.flatten(F.array_repeat(hashes, times))), 1, n)


def signature(seq: Column, k: int, n: int, a: int, b: int) -> Column:
    """The n smallest hashes of the multiset of k-mers; those of short sequences are repeated."""
    return smallest(word_hashes(kmers(seq, k), a, b), n)


def signature_distance(x: Column, y: Column) -> Column:
    """Jaccard distance estimated from two signatures of distinct hashes: over the n smallest of their union."""
    n = F.size(x)
    both = F.slice(F.array_sort(F.array_union(x, y)), 1, n)
    return 1 - F.size(F.array_intersect(F.array_intersect(x, y), both)) / F.size(both)


def jaccard_of_mash(distance: float, k: int) -> float:
    """Jaccard distance that the Mash distance stands for."""
    return 1 - 1 / (2 * math.exp(k * distance) - 1)


def jaccard_of_mash_column(distance: Column, k: int) -> Column:
    return 1 - 1 / (2 * F.exp(distance * k) - 1)


def sampled_positions(length: int, k: int, tables: int, seed: int = 0) -> list[list[int]]:
    """Positions (from 1) whose letters make each table's key, by a fixed rule."""
    rule = lambda t, i: (1103515245 * (seed + 1 + t * k + i) + 12345) >> 4
    return [[rule(t, i) % length + 1 for i in range(k)] for t in range(tables)]


def position_key(seq: Column, positions: Sequence[int]) -> Column:
    return F.concat(*[F.substring(seq, p, 1) for p in positions])


def round_down(x: Column, base: float) -> Column:
    return (F.floor(x / base) * base).cast("bigint")


def round_up(x: Column, base: float) -> Column:
    return (F.ceil(x / base) * base).cast("bigint")


def tables_needed(p1: float, k: int, report: float) -> int:
    """Hash tables that report a near pair with the given probability."""
    if not 0 < p1 <= 1:
        raise ValueError("near pairs must be able to share a hash")
    return 1 if p1 == 1 else math.ceil(math.log(1 - report) / math.log(1 - p1**k))

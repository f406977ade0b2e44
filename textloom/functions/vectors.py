"""Vector functions as Column expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the digits of a bigram's two places
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
BIGRAMS = len(ALPHABET) ** 2


def dot(a: Column, b: Column) -> Column:
    """Sum of products; vectors of unequal size raise."""
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal size")).cast("double"))
    return F.coalesce(same, F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """NaN if a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size))


def normalize(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def random_unit_vectors(count: int, dimensions: int, seed: int) -> list[list[float]]:
    """Unit vectors with components drawn evenly from [0, 1)."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        v = [rng.random() for _ in range(dimensions)]
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v])
    return out


def sign_hash(v: Column, projections: Column) -> Column:
    """32 bits: bit i (modulo 32) is set if the dot product with projection i is positive."""
    bits = F.transform(projections, lambda p, i: F.when(F.aggregate(F.zip_with(v, p, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) > 0, F.pow(F.lit(2.0), F.pmod(i, F.lit(32))).cast("long")).otherwise(F.lit(0).cast("long")))
    total = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int")


def bigrams(tokens: Column) -> Column:
    """Codes (0 to 1295) of the letter and digit bigrams of each token; other characters are skipped."""
    plain = F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", ""))
    at = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 97, 87).otherwise(48)
    pairs = F.transform(plain, lambda t: F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: at(F.substring(t, i, F.lit(1))) * 36 + at(F.substring(t, i + 1, F.lit(1))))).otherwise(F.array().cast("array<int>")))
    return F.flatten(pairs)


def bigram_runs(tokens: Column) -> Column:
    """Each bigram of all tokens once, as many times over as it occurs, a blank behind each: "ab ab ab ". In native expressions."""
    plain = F.array_join(F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", "")), " ")
    pairs = F.split(F.regexp_replace(plain, "(?<=[a-z0-9])([a-z0-9])(?=[a-z0-9])", "$1 $1"), " ")
    return F.regexp_extract_all(F.concat(F.array_join(F.sort_array(pairs), " "), F.lit(" ")), F.lit(r"([a-z0-9]{2} )\1*"), F.lit(0))


def bigram_code(pair: Column) -> Column:
    at = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 97, 87).otherwise(48)
    return (at(F.substring(pair, 1, 1)) * 36 + at(F.substring(pair, 2, 1))).cast("int")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, not wherever ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def bigram_vector(tokens: Column) -> Column:
    """Dense counts of all 1,296 bigrams: the runs of the sorted codes, counted once and then spread out."""

    def starts(codes):
        return F.filter(F.sequence(F.lit(0), F.size(codes)), lambda i: (i < F.size(codes)) & ((i == 0) | (F.get(codes, i) != F.get(codes, i - 1))))

    def counts(codes, at):
        ends = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(codes)))
        return F.map_from_arrays(F.transform(at, lambda i: F.get(codes, i)), F.zip_with(at, F.slice(ends, 1, F.size(at)), lambda i, j: j - i))

    def dense(found):
        return F.transform(F.sequence(F.lit(0), F.lit(BIGRAMS - 1)), lambda k: F.coalesce(F.try_element_at(found, k), F.lit(0)).cast("double"))

    return let(F.array_sort(bigrams(tokens)), lambda codes: let(starts(codes), lambda at: let(counts(codes, at), dense)))

"""Which partition of a topic a key goes to, as column expressions: the two hashes that public Kafka clients use by default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 32-bit hash: seed, multiplier, and the masks of unsigned and positive numbers.
SEED, TIMES, WORD, POSITIVE = 0x9747B28C, 0x5BD1E995, 0xFFFFFFFF, 0x7FFFFFFF


def _times(x: Column) -> Column:
    """Product modulo 2^32; the factors are below 2^32 and 2^31, so 64 bits hold it."""
    return (x * F.lit(TIMES)).bitwiseAND(F.lit(WORD))


def _folded(x: Column, bits: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, bits))


def _byte(digits: Column, i: Column) -> Column:
    """The i-th byte of hexadecimal digits."""
    return F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")


def murmur2(key: str | Column) -> Column:
    """The 32-bit hash of a text's UTF-8 bytes, as a number from 0 to 2^32 - 1; null for null."""
    digits = F.hex(F.encode(key, "utf-8"))
    n = F.octet_length(key)
    whole = F.floor(n / 4)

    def word(i):
        byte = lambda j: F.shiftleft(_byte(digits, i * 4 + j), 8 * j)
        return byte(0) + byte(1) + byte(2) + byte(3)

    words = F.transform(F.slice(F.sequence(F.lit(0), whole), F.lit(1), whole.cast("int")), word)
    mixed = F.aggregate(words, F.lit(SEED).bitwiseXOR(n.cast("bigint")), lambda h, k: _times(h).bitwiseXOR(_times(_folded(_times(k), 24))))
    rest = n - whole * 4
    tail = lambda j: F.when(rest > j, F.shiftleft(_byte(digits, whole * 4 + j), 8 * j)).otherwise(F.lit(0).cast("bigint"))
    ended = F.when(rest > 0, _times(mixed.bitwiseXOR(tail(0) + tail(1) + tail(2)))).otherwise(mixed)
    return _folded(_times(_folded(ended, 13)), 15)


def murmur2_partition(key: str | Column, partitions: int) -> Column:
    """Where the Java producer puts a record with this key."""
    return (murmur2(key).bitwiseAND(F.lit(POSITIVE)) % partitions).cast("int")


def crc32_partition(key: str | Column, partitions: int) -> Column:
    """Where a librdkafka producer with its default partitioner puts a record with this key."""
    return (F.crc32(F.encode(key, "utf-8")) % partitions).cast("int")

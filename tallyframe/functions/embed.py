"""Text -> vector functions (P1), native Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.util import let

# Fixed values of the hash embedding: sha-256 digest, big-endian 16-bit words,
# each taken modulo 1000, then divided by their sum (1 when the sum is 0).
HASH_WORD_MODULUS = 1000
DEFAULT_DIM = 16


def _words_from_hex(hexd: Column, dim: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(
            F.conv(F.substring(hexd, i * 4 + 1, F.lit(4)), 16, 10).try_cast("int") % HASH_WORD_MODULUS,
            F.lit(0)),
    )


def hash_words(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """``ARRAY<INT>`` of the ``dim`` big-endian 16-bit words of sha256(utf8(text))
    modulo 1000. Words past the 32-byte digest are 0. The digest is computed
    once per row (bound to a lambda variable, not copied per word)."""
    return let(F.sha2(text, 256), lambda h: _words_from_hex(h, dim))


def hash_embed(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """``ARRAY<FLOAT>`` hash embedding: words / sum(words) (sum 0 -> 1).

    Native expressions only; the digest and the word list are each
    evaluated once per row."""
    def normalise(words):
        total = F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        norm = F.when(total == 0, F.lit(1)).otherwise(total).cast("double")
        return F.transform(words, lambda x: (x.cast("double") / norm).cast("float"))
    return F.when(text.isNotNull(), let(hash_words(text, dim), normalise))


def squared_l2(a: Column, b: Column) -> Column:
    """Exact squared Euclidean distance of two equal-length numeric arrays,
    computed in DOUBLE."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0).cast("double"), lambda acc, x: acc + x)

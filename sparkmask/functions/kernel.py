"""Keyed digests as Column expressions.

A value's digest is HMAC-SHA256(key, version + len32(namespace) + namespace + len32(value) + value), where the
key is HKDF-SHA256 of the job's seed with the namespace as info. The key is a constant of the plan, so the HMAC
is two sha2 calls over literals and the value's bytes: no Python per row, all inside generated code. Each
digest is made in an inner projection and sliced in an outer one, so it is computed once per row.

The same formulas exist as DuckDB SQL (`sql_digest`) for value checks.
"""

from __future__ import annotations

import hashlib
import hmac
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MaskError

VERSION = 5
#: HKDF salt. A deployment that must reproduce values masked elsewhere sets its own in global_settings.derivation_salt.
SALT = b"sparkmask/determinism/v1"
#: The largest pool that an index may be drawn from.
MAX_POOL = 2**56
#: Characters that may change under NFC: marks, Hangul parts and singletons.
UNSAFE = r"[\p{M}ʹ;΅·ᄀ-ᇿά-´  ΩKÅ〈〉ꥠ-꥿가-퟿豈-﫿]"


def hkdf(ikm: bytes, salt: bytes, info: bytes, length: int = 32) -> bytes:
    """RFC 5869 with SHA-256."""
    if not 0 < length <= 255 * 32:
        raise MaskError("hkdf_length", str(length))
    prk = hmac.new(salt or bytes(32), ikm, hashlib.sha256).digest()
    out, block = b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(prk, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:length]


def seed_bytes(seed: int | str | None) -> bytes:
    """A job seed as 8 bytes: an integer in [0, 2^64), or its text; none is 0."""
    if seed is None:
        return bytes(8)
    if isinstance(seed, bool | float):
        raise MaskError("seed_not_numeric", repr(seed))
    try:
        n = int(seed)
    except ValueError:
        raise MaskError("seed_not_numeric", repr(seed)) from None
    if not 0 <= n < 2**64:
        raise MaskError("seed_overflow", repr(seed))
    return n.to_bytes(8, "big")


def key_resolver(master: bytes, label: str, salt: bytes = SALT):
    """info -> 32-byte key, derived from a 32-byte master key and a pipeline's label."""
    if len(master) != 32:
        raise MaskError("master_key_length", str(len(master)))
    base = hkdf(master, salt, f"pipeline:{label}".encode())
    return lambda info: hkdf(base, salt, info.encode() if isinstance(info, str) else info)


def envelope(namespace: str) -> bytes:
    ns = namespace.encode()
    return bytes([VERSION]) + struct.pack(">I", len(ns)) + ns


def canonical(value) -> bytes:
    """The bytes of a Python value that `canonical_column` makes in Spark."""
    import datetime
    import decimal
    import unicodedata

    if isinstance(value, bool):
        return b"\x01" if value else b"\x00"
    if isinstance(value, int):
        n = (value.bit_length() + 8) // 8
        return struct.pack(">I", n) + value.to_bytes(n, "big", signed=True)
    if isinstance(value, float):
        raise MaskError("float_canonicalization_unsupported")
    if isinstance(value, bytes):
        return value
    if isinstance(value, datetime.datetime):
        if value.tzinfo is None:
            raise MaskError("naive_datetime_unsupported")
        return value.astimezone(datetime.UTC).isoformat().encode()
    if isinstance(value, datetime.date):
        return value.isoformat().encode()
    if isinstance(value, decimal.Decimal):
        return str(value).encode()
    return unicodedata.normalize("NFC", str(value)).encode()


class Kernel:
    """Derivations of one job: seed and salt."""

    def __init__(self, seed: int | str | None = None, salt: bytes | str = SALT):
        self.seed = seed_bytes(seed)
        self.salt = salt.encode() if isinstance(salt, str) else salt

    def key(self, namespace: str) -> bytes:
        return hkdf(self.seed, self.salt, namespace.encode())

    def derive(self, namespace: str, source: bytes) -> bytes:
        """The digest of one value, on the driver."""
        return hmac.new(self.key(namespace), envelope(namespace) + struct.pack(">I", len(source)) + source, hashlib.sha256).digest()

    def derive_index(self, namespace: str, source: bytes, size: int) -> int:
        check_pool(size)
        return int.from_bytes(self.derive(namespace, source)[:8], "big") % size

    def pads(self, namespace: str) -> tuple[bytes, bytes]:
        key = self.key(namespace).ljust(64, b"\0")
        return bytes(x ^ 0x36 for x in key) + envelope(namespace), bytes(x ^ 0x5C for x in key)

    def digest(self, namespace: str, source: Column) -> Column:
        """64 hex digits of the digest of a binary column; null for null."""
        inner, outer = self.pads(namespace)
        size = F.unhex(F.lpad(F.hex(F.octet_length(source).cast("long")), 8, "0"))
        return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), size, source), 256))), 256)

    def of(self, namespace: str, column: Column, kind: T.DataType, **options) -> Column:
        return self.digest(namespace, canonical_column(column, kind, **options))

    def sql_digest(self, namespace: str, blob: str) -> str:
        """DuckDB SQL for `digest` of an expression of type BLOB."""
        inner, outer = self.pads(namespace)
        size = f"unhex(lpad(hex(octet_length({blob})), 8, '0'))"
        return f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || {size} || {blob})))"


def check_pool(size: int) -> None:
    if not 1 <= size <= MAX_POOL:
        raise MaskError("pool_size_out_of_range", str(size))


def slice_number(digest: Column, first_byte: int, n_bytes: int) -> Column:
    """Bytes of a digest as an unsigned number: long up to 7 bytes, decimal(20,0) for 8."""
    text = F.conv(F.substring(digest, 2 * first_byte + 1, 2 * n_bytes), 16, 10)
    return text.cast("long" if n_bytes < 8 else "decimal(20,0)")


def index_of(digest: Column, size: int) -> Column:
    """The index that a digest's first 8 bytes give in a pool (long, from 0)."""
    check_pool(size)
    if size < 2**31:  # two halves by Horner's rule stay in longs
        return (slice_number(digest, 0, 4) % size * F.lit(2**32 % size) + slice_number(digest, 4, 4)) % size
    return (slice_number(digest, 0, 8) % F.lit(size).cast("decimal(20,0)")).cast("long")


def sql_index(digest: str, size: int, first_byte: int = 0) -> str:
    """DuckDB SQL for `index_of`."""
    return f"CAST(CAST('0x' || substr({digest}, {2 * first_byte + 1}, 16) AS UBIGINT) % {size} AS BIGINT)"


def unit(digest: Column, first_byte: int = 0) -> Column:
    """A uniform double in [0, 1) from 6 bytes of a digest."""
    return slice_number(digest, first_byte, 6).cast("double") / F.lit(float(2**48))


def sql_unit(digest: str, first_byte: int = 0) -> str:
    return f"(CAST(CAST('0x' || substr({digest}, {2 * first_byte + 1}, 12) AS UBIGINT) AS DOUBLE) / {float(2**48)})"


def integer_bytes(column: Column) -> Column:
    n = column.cast("long")
    size = F.abs(n.cast("decimal(20,0)"))
    steps = [(k, 2 ** (8 * k - 1)) for k in range(1, 9)]
    count = F.lit(9)
    for k, bound in reversed(steps):
        count = F.when(size < F.lit(str(bound)).cast("decimal(20,0)"), k).otherwise(count)
    padded = F.concat(F.when(n < 0, "FF").otherwise("00"), F.lpad(F.hex(n), 16, "0"))
    return F.unhex(F.concat(F.lpad(F.hex(count.cast("long")), 8, "0"), F.substring(padded, F.lit(19) - 2 * count, 2 * count)))


def sql_integer_bytes(column: str) -> str:
    """DuckDB SQL for `integer_bytes` of an integer expression."""
    n = f"CAST({column} AS HUGEINT)"
    steps = " ".join(f"WHEN abs({n}) < {2 ** (8 * k - 1)} THEN {k}" for k in range(1, 9))
    count = f"(CASE {steps} ELSE 9 END)"
    full = f"lpad(hex({n} & 18446744073709551615::HUGEINT), 16, '0')"
    return f"unhex(lpad(hex({count}), 8, '0') || right((CASE WHEN {n} < 0 THEN 'FF' ELSE '00' END) || {full}, 2 * {count}))"


def nfc_udf():
    @F.pandas_udf("string")
    def nfc(x: pd.Series) -> pd.Series:
        return x.str.normalize("NFC")

    return nfc


def value_list(values: list) -> Column:
    """Values as one literal array; texts travel as one string that the optimizer splits once."""
    if values and all(isinstance(v, str) and "\x1f" not in v for v in values):
        return F.split(F.lit("\x1f".join(values)), "\x1f")
    return F.array(*[F.lit(v) for v in values])


def canonical_column(column: Column, kind: T.DataType, assume_utc: bool = False, nfc: bool = False) -> Column:
    """The canonical bytes of a column, by its type. nfc: whether texts may need normalising (see `needs_nfc`)."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return integer_bytes(column)
    if isinstance(kind, T.BooleanType):
        return F.when(column, F.lit(b"\x01")).when(~column, F.lit(b"\x00"))
    if isinstance(kind, T.FloatType | T.DoubleType):
        raise MaskError("float_canonicalization_unsupported", kind.simpleString())
    if isinstance(kind, T.TimestampNTZType) and not assume_utc:
        raise MaskError("naive_datetime_unsupported", "cast to date or text, or set assume_utc")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(column, "SSSSSS")
        return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00")).cast("binary")
    if isinstance(kind, T.BinaryType):
        return column
    if isinstance(kind, T.StringType | T.DecimalType | T.DateType | T.CharType | T.VarcharType):
        text = column.cast("string")
        if nfc and not isinstance(kind, T.DecimalType | T.DateType):
            text = F.when(text.rlike(UNSAFE), nfc_udf()(F.when(text.rlike(UNSAFE), text))).otherwise(text)
        return text.cast("binary")
    raise MaskError("type_canonicalization_unsupported", kind.simpleString())


def needs_nfc(df, columns: list[str]) -> list[str]:
    """The text columns of which some value may change under NFC: one aggregate over the data."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return []
    row = df.agg(*[F.max(F.col(c).rlike(UNSAFE).cast("int")).alias(c) for c in texts]).first()
    return [c for c in texts if row[c]]

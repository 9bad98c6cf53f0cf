import hashlib
import hmac
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmask.errors import MaskError
from sparkmask.functions import identifiers as ids
from sparkmask.functions import kernel as k
from sparkmask.functions.fpe import CHARSETS, Cipher, luhn_digit


def test_hkdf_rfc_5869_case_1():
    out = k.hkdf(bytes.fromhex("0b" * 22), bytes(range(13)), bytes(range(0xF0, 0xFA)), 42)
    assert out.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


def test_digest_is_hmac(spark):
    kernel = k.Kernel(7)
    values = [0, 1, -1, 127, 128, -128, -129, 255, 256, 2**31, -(2**31), 2**55, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for row in df.select("v", kernel.of("ns", F.col("v"), T.LongType()).alias("h")).collect():
        src = k.canonical(row.v)
        msg = b"\x05" + struct.pack(">I", 2) + b"ns" + struct.pack(">I", len(src)) + src
        assert row.h == hmac.new(kernel.key("ns"), msg, hashlib.sha256).hexdigest()


def test_widths_agree(spark):
    df = spark.sql("select cast(5 as int) a, cast(5 as bigint) b, cast(5 as smallint) c")
    kernel = k.Kernel(1)
    row = df.select(*[kernel.of("n", F.col(c), df.schema[c].dataType).alias(c) for c in "abc"]).first()
    assert row.a == row.b == row.c


def test_texts_are_normalised(spark):
    kernel = k.Kernel(1)
    df = spark.createDataFrame([("é",), ("é",)], "s string")
    assert k.needs_nfc(df, ["s"]) == ["s"]
    h = [r.h for r in df.select(kernel.of("n", F.col("s"), T.StringType(), nfc=True).alias("h")).collect()]
    assert h[0] == h[1] == kernel.derive("n", "é".encode()).hex()


def test_index_matches_python(spark):
    kernel = k.Kernel(3)
    df = spark.range(50)
    for r in df.select("id", k.index_of(kernel.of("p", F.col("id"), T.LongType()), 77).alias("i")).collect():
        assert r.i == kernel.derive_index("p", k.canonical(r.id), 77)


@pytest.mark.parametrize(("kind", "code"), [(T.DoubleType(), "float_canonicalization_unsupported"), (T.TimestampNTZType(), "naive_datetime_unsupported")])
def test_refused_types(spark, kind, code):
    with pytest.raises(MaskError) as e:
        k.canonical_column(F.col("x"), kind)
    assert e.value.code == code


def test_seeds():
    assert k.seed_bytes(None) == bytes(8)
    for bad, code in ((True, "seed_not_numeric"), (1.5, "seed_not_numeric"), ("x", "seed_not_numeric"), (-1, "seed_overflow"), (2**64, "seed_overflow")):
        with pytest.raises(MaskError) as e:
            k.seed_bytes(bad)
        assert e.value.code == code


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(sorted(CHARSETS)), st.data())
def test_fpe_round_trip(charset, data):
    text = data.draw(st.text(alphabet=CHARSETS[charset] + "-. ", max_size=24))
    c = Cipher(b"k" * 32, "col", charset)
    e = c.apply(text)
    assert len(e) == len(text) and c.apply(e, -1) == text
    assert [x for x in e if x in "-. "] == [x for x in text if x in "-. "]


def test_fpe_is_a_bijection():
    c = Cipher(b"k" * 32, "col", "digits")
    for width in (1, 2, 3):
        assert len({c.apply(f"{i:0{width}d}") for i in range(10**width)}) == 10**width


def test_fpe_luhn():
    c = Cipher(b"k" * 32, "pan", "digits", validate_luhn=True)
    pan = "411111111111111" + luhn_digit("411111111111111")
    e = c.apply(pan)
    assert e[-1] == luhn_digit(e[:-1]) and c.apply(e, -1) == pan


#: A digest none of whose four slices is an SSN, and one whose last slice is.
NO_SSN, LAST_SSN = "0" * 64, "0" * 56 + f"{123456789:08x}"


def test_ssn_is_null_without_an_allowed_slice(spark):
    df = spark.createDataFrame([(NO_SSN,), (LAST_SSN,)], "h string")
    assert [r.s for r in df.select(ids.ssn(F.col("h")).alias("s")).collect()] == [None, "123-45-6789"]


def test_ssn_provider_gives_every_digest_an_allowed_number(spark):
    make, valid = ids.IDENTIFIERS["synthetic_ssn"], ids.VALIDATORS["synthetic_ssn"]
    df = spark.range(3000).select(F.concat(F.lit("0" * 56), F.lpad(F.hex("id"), 8, "0")).alias("h")).union(spark.createDataFrame([(NO_SSN,), (LAST_SSN,)], "h string"))
    rows = df.select(make(F.col("h")).alias("s"), F.coalesce(valid(make(F.col("h"))), F.lit(False)).alias("ok"), ids.ssn(F.col("h")).alias("plain")).collect()
    assert all(r.ok for r in rows) and len({r.s for r in rows}) > 2990
    assert sum(r.plain is None for r in rows) == 3001 and rows[-1].s == "123-45-6789"  # digests with slices keep their number

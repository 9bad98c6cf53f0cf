"""Valid-looking identifiers from slices of a digest, and validators, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MaskError
from .kernel import slice_number

#: Characters of a CUSIP body in the order of their values.
CUSIP_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"
#: The last category of ICD-10-CM chapters that don't run to 99; F starts at 1.
ICD10_LAST = {"D": 89, "E": 89, "H": 95, "K": 95, "P": 96, "T": 88, "U": 85}
ICD10_FIRST = {"F": 1}
ICD10_CHAPTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: EIN prefixes that the IRS has assigned.
EIN_PREFIXES = [*range(1, 7), *range(10, 17), *range(20, 28), *range(30, 49), *range(50, 69), *range(71, 78), *range(80, 89), *range(90, 96), 98, 99]
#: NDC segment layouts.
NDC_LAYOUTS = ((4, 4, 2), (5, 3, 2), (5, 4, 1), (5, 4, 2))
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def digits(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def modulo(digest: Column, first: int, n: int, size: int) -> Column:
    """Bytes of a digest modulo a size, as a long; nine bytes and more go by Horner's rule over pieces of six."""
    value, at, end = None, first, first + n
    while at < end:
        take = min(6, end - at)
        piece = slice_number(digest, at, take)
        value = piece % size if value is None else (value * F.lit(pow(256, take, size)) + piece) % size
        at += take
    return value


def luhn(body: Column, width: int) -> Column:
    """The Luhn check digit of `width` digits."""
    total = F.lit(0)
    for i in range(width):
        d = F.substring(body, width - i, 1).cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 == 0 else d)
    return F.pmod(-total, F.lit(10)).cast("string")


def ssn(digest: Column) -> Column:
    """XXX-XX-XXXX of the first of four slices that the rules allow; null if none is (about 1 in 6,600)."""
    out = None
    for at in (24, 16, 8, 0):
        d = digits(slice_number(digest, at, 8) % F.lit("1000000000").cast("decimal(20,0)"), 9)
        ok = ssn_ok(d)
        out = F.when(ok, d).otherwise(out if out is not None else F.lit(None).cast("string"))
    return ssn_parts(F.substring(out, 1, 3), F.substring(out, 4, 2), F.substring(out, 6, 4))


def ssn_parts(area: Column, group: Column, serial: Column) -> Column:
    return F.concat(area, F.lit("-"), group, F.lit("-"), serial)  # null if a part is, unlike concat_ws


def any_ssn(digest: Column) -> Column:
    """`ssn`, and where it is null, a number that the digest's own digest draws from all that the rules allow."""
    n = modulo(F.sha2(digest, 256), 0, 8, 898 * 99 * 9999)
    serial, n = n % 9999 + 1, F.floor(n / 9999)
    group, area = n % 99 + 1, F.floor(n / 99) + 1
    area = F.when(area < 666, area).otherwise(area + 1)  # 001 to 899 without 666
    return F.coalesce(ssn(digest), ssn_parts(digits(area, 3), digits(group, 2), digits(serial, 4)))


def ssn_ok(d: Column) -> Column:
    return d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def ein(digest: Column) -> Column:
    prefix = F.element_at(F.array(*[F.lit(f"{p:02d}") for p in EIN_PREFIXES]), (modulo(digest, 0, 4, len(EIN_PREFIXES)) + 1).cast("int"))
    return F.concat(prefix, F.lit("-"), digits(modulo(digest, 4, 8, 10_000_000), 7))


def npi(digest: Column) -> Column:
    body = F.concat(F.when(slice_number(digest, 0, 1) % 2 == 0, "1").otherwise("2"), digits(modulo(digest, 1, 8, 100_000_000), 8))
    return F.concat(body, luhn(F.concat(F.lit("80840"), body), 14))


def pan(digest: Column, iin: str = "411111") -> Column:
    body = F.concat(F.lit(iin), digits(modulo(digest, 0, 9, 1_000_000_000), 9))
    return F.concat(body, luhn(body, 15))


def icd10(digest: Column) -> Column:
    chapter = F.substring(F.lit(ICD10_CHAPTERS), (slice_number(digest, 0, 1) % 26 + 1).cast("int"), F.lit(1))
    lo = F.lit(0)
    for c, n in ICD10_FIRST.items():
        lo = F.when(chapter == c, n).otherwise(lo)
    hi = F.lit(99)
    for c, n in ICD10_LAST.items():
        hi = F.when(chapter == c, n).otherwise(hi)
    return F.concat(chapter, digits(slice_number(digest, 1, 2) % (hi - lo + 1) + lo, 2), F.lit("."), (slice_number(digest, 3, 1) % 10).cast("string"))


def iban(digest: Column) -> Column:
    """Country by the first byte, account digits by the other 31 modulo a power of ten, check digits by ISO 13616."""
    countries = sorted(IBAN_LENGTHS)
    at = (slice_number(digest, 0, 1) % len(countries) + 1).cast("int")
    country = F.element_at(F.array(*map(F.lit, countries)), at)
    width = F.element_at(F.array(*[F.lit(IBAN_LENGTHS[c] - 4) for c in countries]), at)
    big = "decimal(38,0)"
    value = F.lit(0).cast(big)  # modulo 10^29: times 2^24 it still fits a decimal(38,0)
    for first in range(1, 32, 3):
        n = min(3, 32 - first)
        value = ((value * F.lit(256**n).cast("decimal(8,0)") + slice_number(digest, first, n).cast("decimal(8,0)")).cast(big) % F.lit(str(10**29)).cast(big)).cast(big)
    account = F.right(F.lpad(value.cast("string"), 29, "0"), width)
    tail = F.concat(*[(F.ascii(F.substring(country, i, 1)) - 55).cast("string") for i in (1, 2)], F.lit("00"))
    return F.concat(country, digits(F.lit(98) - mod97(F.lpad(F.concat(account, tail), 36, "0"), 36), 2), account)


def mod97(text: Column, width: int) -> Column:
    value = F.lit(0).cast("long")
    for i in range(0, width, 9):
        n = min(9, width - i)
        value = (value * F.lit(10**n) + F.substring(text, i + 1, n).cast("long")) % 97
    return value


def whole(n: Column, by: int) -> Column:
    """n div by, exactly."""
    return ((n - n % by) / F.lit(by).cast("decimal(20,0)")).cast("long") if by > 1 else n


def cusip(digest: Column) -> Column:
    n = (slice_number(digest, 0, 8) % F.lit(str(39**8)).cast("decimal(20,0)")).cast("long")
    body = F.concat(*[F.substring(F.lit(CUSIP_ALPHABET), (1 + F.pmod(whole(n, 39**i), F.lit(39))).cast("int"), F.lit(1)) for i in range(7, -1, -1)])
    return F.concat(body, cusip_digit(body))


def cusip_digit(body: Column) -> Column:
    total = F.lit(0)
    for i in range(8):
        v = F.position(F.substring(body, i + 1, 1), F.lit(CUSIP_ALPHABET)) - 1
        v = 2 * v if i % 2 else v
        total = total + F.floor(v / 10) + v % 10
    return F.pmod(-total, F.lit(10)).cast("int").cast("string")


def mrn(digest: Column, digit_count: int = 8, alpha_prefix: str = "", allow_leading_zero: bool = False) -> Column:
    d = digits(slice_number(digest, 0, 8) % F.lit(str(10**digit_count)).cast("decimal(20,0)"), digit_count)
    if not allow_leading_zero:
        d = F.when(d.startswith("0"), F.concat(F.lit("1"), F.substring(d, 2, digit_count))).otherwise(d)
    return F.concat(F.lit(alpha_prefix), d)


def ndc(digest: Column, layout: tuple[int, int, int] = (5, 4, 2)) -> Column:
    if tuple(layout) not in NDC_LAYOUTS:
        layout = (5, 4, 2)
    return F.concat_ws("-", *[digits(slice_number(digest, 4 * i, 4) % 10**n, n) for i, n in enumerate(layout)])


#: Providers that `strategy: faker` derives straight from the digest.
IDENTIFIERS = {"synthetic_ssn": any_ssn, "synthetic_ein": ein, "synthetic_npi": npi, "synthetic_pan": pan, "synthetic_icd10": icd10, "synthetic_iban": iban, "synthetic_cusip": cusip, "synthetic_mrn": mrn, "synthetic_ndc": ndc}


def is_icd10(text: Column) -> Column:
    v = F.regexp_replace(F.upper(F.trim(text)), r"\.", "")
    cat = F.substring(v, 2, 2).try_cast("int")
    ok = v.rlike("^[A-Z][0-9]{2}[A-Z0-9]{0,4}$")
    for c, n in ICD10_LAST.items():
        ok = ok & ~((F.substring(v, 1, 1) == c) & (cat > n))
    return ok & ~(v.startswith("F") & (cat < 1))


def is_iban(text: Column) -> Column:
    v = F.upper(F.regexp_replace(text, r"\s", ""))
    moved = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    shape = v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    steps = F.aggregate(F.split(F.when(shape, moved).otherwise(F.lit("0")), ""), F.lit(0).cast("long"), lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + c.try_cast("long")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return shape & (steps == 1)


def luhn_check(text: Column) -> Column:
    return F.call_function("luhn_check", text)


def is_luhn(text: Column) -> Column:
    d = F.regexp_replace(text, r"[\s-]", "")
    return d.rlike("^[0-9]+$") & luhn_check(d)


def is_npi(text: Column) -> Column:
    return text.rlike("^[0-9]{10}$") & luhn_check(F.concat(F.lit("80840"), text))


def is_ipv4(text: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|0{0,2}[0-9]|0?[1-9][0-9])"
    return text.rlike(rf"^{octet}(\.{octet}){{3}}$")


def is_cusip(text: Column) -> Column:
    return text.rlike(r"^[0-9A-Z*@#]{8}[0-9]$") & (cusip_digit(F.substring(text, 1, 8)) == F.substring(text, 9, 1))


VALIDATORS = {
    "synthetic_ssn": lambda c: ssn_ok(F.regexp_replace(c, "-", "")), "synthetic_ein": lambda c: c.rlike(r"^[0-9]{2}-[0-9]{7}$") & F.substring(c, 1, 2).isin(*[f"{p:02d}" for p in EIN_PREFIXES]),
    "synthetic_npi": lambda c: is_npi(c) & F.substring(c, 1, 1).isin("1", "2"), "synthetic_pan": lambda c: c.rlike("^[0-9]{16}$") & is_luhn(c), "synthetic_icd10": is_icd10, "synthetic_iban": is_iban,
    "synthetic_cusip": is_cusip, "synthetic_mrn": lambda c: c.rlike("^[0-9]{8}$"), "synthetic_ndc": lambda c: c.rlike("^([0-9]{4}-[0-9]{4}-[0-9]{2}|[0-9]{5}-[0-9]{3}-[0-9]{2}|[0-9]{5}-[0-9]{4}-[0-9]{1,2})$"),
}

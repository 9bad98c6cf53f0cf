"""Keyed format-preserving permutation of texts: type-II Feistel rounds with an HMAC-SHA256 round function.

The characters of a charset are one number in mixed halves; eight rounds add a keyed digest of one half to the
other, modulo that half's size, which is a bijection for any charset and length. Other characters keep
their places. Arithmetic goes beyond 64 bits, so this runs in an Arrow batch function over distinct values
of each batch; results don't depend on batching.
"""

from __future__ import annotations

import hashlib
import hmac
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MaskError

#: The named charsets, in code order.
CHARSETS = {
    "digits": string.digits,
    "alpha": string.ascii_lowercase,
    "ALPHA": string.ascii_uppercase,
    "alphanum": string.digits + string.ascii_lowercase,
    "ALPHANUM": string.digits + string.ascii_uppercase + string.ascii_lowercase,
}
ROUNDS = 8


def luhn_digit(body: str) -> str:
    doubled = [sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body))]
    return str(-sum(doubled) % 10)


class Cipher:
    """One column's permutation: key, tweak (its name), charset, and how separators and check digits are treated."""

    def __init__(self, key: bytes, tweak: str, charset: str = "digits", preserve_separators: bool = True, validate_luhn: bool = False):
        self.alphabet = CHARSETS.get(charset, charset)
        if len(set(self.alphabet)) != len(self.alphabet):
            raise MaskError("fpe_charset_repeats", charset)
        self.place = {c: i for i, c in enumerate(self.alphabet)}
        self.key, self.tweak, self.keep, self.luhn = key, tweak.encode(), preserve_separators, validate_luhn

    def noise(self, turn: int, operand: int, size: int) -> int:
        number = operand.to_bytes(max(1, -(-operand.bit_length() // 8)), "big")
        return int.from_bytes(hmac.new(self.key, bytes([turn]) + self.tweak + b"\xff" + number, hashlib.sha256).digest(), "big") % size

    def permute(self, text: str, sign: int) -> str:
        radix, n = len(self.alphabet), len(text)
        if n < 2:
            turn = int.from_bytes(hmac.new(self.key, b"fpe-single\xff" + self.tweak, hashlib.sha256).digest(), "big")
            return "".join(self.alphabet[(self.place[c] + sign * turn) % radix] for c in text)
        number = 0
        for c in text:
            number = number * radix + self.place[c]
        sizes = (radix ** (n - n // 2), radix ** (n // 2))
        halves = list(divmod(number, sizes[1]))
        for turn in range(ROUNDS)[::sign]:
            mine = turn % 2
            halves[mine] = (halves[mine] + sign * self.noise(turn, halves[1 - mine], sizes[mine])) % sizes[mine]
        number = halves[0] * sizes[1] + halves[1]
        out = []
        for _ in range(n):
            number, digit = divmod(number, radix)
            out.append(self.alphabet[digit])
        return "".join(reversed(out))

    def body(self, text: str, sign: int) -> str:
        if self.luhn and len(text) > 1:
            head = self.permute(text[:-1], sign)
            return head + luhn_digit(head)
        return self.permute(text, sign)

    def apply(self, text: str | None, sign: int = 1) -> str | None:
        """Encrypts (sign 1) or decrypts (-1); texts without charset characters, and charsets of one, stay."""
        if not text or len(self.alphabet) < 2:
            return text
        inside = [c for c in text if c in self.place]
        if not inside or (not self.keep and len(inside) < len(text)):
            return text
        moved = iter(self.body("".join(inside), sign))
        return "".join(next(moved) if c in self.place else c for c in text)


def fpe_column(column: Column, cipher: Cipher, sign: int = 1) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        codes, found = pd.factorize(values)
        table = [cipher.apply(x, sign) for x in found] + [None]
        return pd.Series([table[i] for i in codes], dtype=object)

    return run(column.cast("string"))

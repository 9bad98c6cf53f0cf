"""Value lists and pools of synthetic people, places and texts, drawn by keyed digests instead of generators with state."""

from __future__ import annotations

import hashlib

from ..errors import MaskError

FIRST = "Ada Alan Alice Amir Ana Anton Aria Ben Bela Cara Carl Chen Clara Dana David Dina Elena Eli Emma Erik Eva Felix Fiona Gita Hana Hugo Ida Ines Ivan Jana Jonas Julia Kai Karin Lara Leo Lina Luca Maja Marco Maria Mila Nadia Nils Nina Noah Olga Omar Oskar Paula Pia Rafael Rosa Ruth Sami Sara Sofia Theo Tina Uma Vera Viktor Wanda Yara Zoe".split()
LAST = "Abbott Adler Alvarez Arden Baker Bauer Becker Bell Berg Blake Brandt Brooks Carter Castro Chen Clarke Cole Costa Dalton Diaz Doyle Duarte Ellis Engel Falk Fischer Flores Fox Frank Garcia Grant Gray Hahn Hale Hansen Hayes Holm Iyer Jansen Jensen Keller Khan Klein Lang Larsen Lopez Lund Marsh Meyer Mills Moreau Nash Novak Olsen Ortiz Park Patel Quinn Reyes Rossi Sato Silva Stone Torres Vogel Weber Wolf Young".split()
STREETS = "Maple Oak Cedar Pine Elm Lake Hill River Park Main Church Mill Spring Forest Garden Sunset Valley Meadow Harbor Bridge".split()
SUFFIXES = "Street Avenue Road Lane Drive Court Place Way".split()
DOMAINS = ["example.com", "example.org", "example.net"]
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
#: Localities (city, state, zip) that belong together.
LOCALITIES = [
    ("Albany", "NY", "12207"), ("Atlanta", "GA", "30303"), ("Austin", "TX", "78701"), ("Baltimore", "MD", "21202"), ("Boise", "ID", "83702"), ("Boston", "MA", "02108"), ("Buffalo", "NY", "14202"),
    ("Charlotte", "NC", "28202"), ("Chicago", "IL", "60602"), ("Cleveland", "OH", "44113"), ("Columbus", "OH", "43215"), ("Dallas", "TX", "75201"), ("Denver", "CO", "80202"), ("Detroit", "MI", "48226"),
    ("Fresno", "CA", "93721"), ("Hartford", "CT", "06103"), ("Houston", "TX", "77002"), ("Jackson", "MS", "39201"), ("Lincoln", "NE", "68508"), ("Memphis", "TN", "38103"), ("Miami", "FL", "33130"),
    ("Newark", "NJ", "07102"), ("Omaha", "NE", "68102"), ("Orlando", "FL", "32801"), ("Phoenix", "AZ", "85003"), ("Portland", "OR", "97204"), ("Raleigh", "NC", "27601"), ("Reno", "NV", "89501"),
    ("Seattle", "WA", "98104"), ("Tampa", "FL", "33602"), ("Tucson", "AZ", "85701"), ("Tulsa", "OK", "74103"),
]

#: Providers whose values come from a pool; others are derived per row or not poolable.
POOLABLE = ["person_name", "person_first_name", "person_last_name", "person_full_name", "person_email", "person_phone", "person_dob", "address_street", "address_city", "address_state", "address_zip", "synthetic_account_number", "synthetic_member_id", "synthetic_plan_id"]
NON_POOLABLE = ["address_full", "lorem_text", "uuid", "random_int_range", "random_choice"]
COMPOSITES = ["composite_name_email", "composite_city_state_zip", "composite_person", "composite_address", "composite_provider", "composite_custom"]
CUSTOM: dict[str, object] = {}


def register_provider(name: str, source) -> None:
    """A custom provider `custom.<name>`: a list of values, or a callable of an integer that gives one."""
    CUSTOM[f"custom.{name}"] = source


class Draws:
    """A stream of numbers from a hash, for building pools on the driver: equal arguments, equal stream."""

    def __init__(self, *key):
        self.key, self.n = repr(key).encode(), 0

    def below(self, size: int) -> int:
        self.n += 1
        return int.from_bytes(hashlib.sha256(self.key + self.n.to_bytes(8, "big")).digest()[:8], "big") % size

    def of(self, values: list):
        return values[self.below(len(values))]


def one(provider: str, d: Draws, options: dict) -> str:
    kind = provider.removeprefix("person_").removeprefix("address_").removeprefix("synthetic_")
    if kind in ("name", "full_name"):
        return f"{d.of(FIRST)} {d.of(LAST)}"
    if kind == "first_name":
        return d.of(FIRST)
    if kind == "last_name":
        return d.of(LAST)
    if kind == "email":
        return f"{d.of(FIRST)}.{d.of(LAST)}{d.below(10_000)}@{d.of(DOMAINS)}".lower()
    if kind == "phone":
        return f"{2 + d.below(8)}{d.below(100):02d}-555-{d.below(10_000):04d}"
    if kind == "dob":
        return f"{1930 + d.below(75)}-{1 + d.below(12):02d}-{1 + d.below(28):02d}"
    if kind == "street":
        return f"{1 + d.below(9999)} {d.of(STREETS)} {d.of(SUFFIXES)}"
    if kind in ("city", "state", "zip"):
        return d.of(LOCALITIES)[("city", "state", "zip").index(kind)]
    if kind == "full":
        city, state, code = d.of(LOCALITIES)
        return f"{1 + d.below(9999)} {d.of(STREETS)} {d.of(SUFFIXES)}, {city}, {state} {code}"
    if kind == "text" or kind == "lorem_text":
        return " ".join(d.of(LOREM) for _ in range(int(options.get("words", 8)))).capitalize() + "."
    if kind in ("account_number", "member_id", "plan_id"):
        head = {"account_number": "", "member_id": "M", "plan_id": "P"}[kind]
        return f"{head}{d.below(10**10):010d}"
    if kind == "uuid":
        h = hashlib.sha256(d.key + d.below(2**62).to_bytes(8, "big")).hexdigest()
        return f"{h[:8]}-{h[8:12]}-4{h[13:16]}-a{h[17:20]}-{h[20:32]}"
    if kind == "random_int_range":
        lo, hi = int(options.get("min", 0)), int(options.get("max", 100))
        return str(lo + d.below(hi - lo + 1))
    if kind == "random_choice":
        return str(d.of(list(options["choices"])))
    raise MaskError("unknown_provider", provider)


def pool(provider: str, size: int, *identity, options: dict | None = None, distinct: bool = True) -> list[str]:
    """`size` values of a provider, the same for the same identity; distinct where the provider has enough of them."""
    options = options or {}
    custom = CUSTOM.get(provider)
    if isinstance(custom, list | tuple):
        return list(dict.fromkeys(custom))[:size]
    d = Draws(provider, *identity)
    out: dict[str, None] = {}
    for i in range(4 * size):
        out[custom(i) if callable(custom) else one(provider, d, options)] = None
        if len(out) == size:
            break
    return list(out)


def known(provider: str) -> bool:
    from .identifiers import IDENTIFIERS

    return provider in POOLABLE or provider in NON_POOLABLE or provider in COMPOSITES or provider in IDENTIFIERS or provider in CUSTOM

"""Bundles: columns that are masked together from one digest, so that they fit each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MaskError
from ..functions import identifiers as ids
from ..functions.kernel import slice_number
from ..functions.words import DOMAINS, FIRST, LAST, LOCALITIES, STREETS, SUFFIXES

#: Outputs of each bundle provider, in order.
OUTPUTS = {
    "composite_name_email": ("name", "email"),
    "composite_city_state_zip": ("city", "state", "zip"),
    "composite_person": ("first_name", "last_name", "email", "dob"),
    "composite_address": ("street", "city", "state", "zip"),
    "composite_provider": ("npi", "name", "street", "city", "state", "zip"),
}


def draw(digest: Column, slot: int, values: list) -> Column:
    """A value by the slot's eight bytes."""
    return F.element_at(F.array(*map(F.lit, values)), (ids.modulo(digest, 8 * slot, 8, len(values)) + 1).cast("int"))


def locality(digest: Column, slot: int) -> Column:
    table = F.array(*[F.struct(F.lit(c).alias("city"), F.lit(s).alias("state"), F.lit(z).alias("zip")) for c, s, z in LOCALITIES])
    return F.element_at(table, (ids.modulo(digest, 8 * slot, 8, len(LOCALITIES)) + 1).cast("int"))


def street(digest: Column, slot: int) -> Column:
    n = slice_number(digest, 8 * slot, 6)
    name = F.element_at(F.array(*[F.lit(f"{a} {b}") for a in STREETS for b in SUFFIXES]), (n % (len(STREETS) * len(SUFFIXES)) + 1).cast("int"))
    return F.concat((n % 9973 + 1).cast("string"), F.lit(" "), name)


def bundle(digest: Column, provider: str, options: dict | None = None) -> dict[str, Column]:
    """The bundle's columns. `digest` should be a column made in an inner projection: every output slices it."""
    first, last = draw(digest, 0, FIRST), draw(digest, 1, LAST)
    email = F.lower(F.concat(first, F.lit("."), last, F.lit("@"), draw(digest, 2, DOMAINS)))
    if provider == "composite_name_email":
        return {"name": F.concat_ws(" ", first, last), "email": email}
    if provider == "composite_person":
        days = slice_number(digest, 24, 6) % 27_000
        return {"first_name": first, "last_name": last, "email": email, "dob": F.date_format(F.date_add(F.lit("1930-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")}
    if provider == "composite_city_state_zip":
        place = locality(digest, 0)
        return {k: place[k] for k in ("city", "state", "zip")}
    if provider == "composite_address":
        place = locality(digest, 1)
        return {"street": street(digest, 0)} | {k: place[k] for k in ("city", "state", "zip")}
    if provider == "composite_provider":
        place = locality(digest, 3)
        return {"npi": ids.npi(digest), "name": F.concat_ws(" ", draw(digest, 1, FIRST), draw(digest, 2, LAST)), "street": street(digest, 2)} | {k: place[k] for k in ("city", "state", "zip")}
    if provider == "composite_custom":
        slots = list((options or {}).get("slots") or [])
        if not 1 <= len(slots) <= 4 or len({s["column"] for s in slots}) < len(slots):
            raise MaskError("composite_custom_slots", str(len(slots)))
        return {s["column"]: draw(digest, i, list(s["values"])) for i, s in enumerate(slots)}
    raise MaskError("unknown_provider", provider)


def check_wiring(columns: list[str], provider: str, namespace: str | None, options: dict | None = None) -> None:
    if provider not in OUTPUTS and provider != "composite_custom":
        raise MaskError("unknown_provider", provider)
    if namespace is None:
        raise MaskError("deterministic_namespace_missing", provider)
    want = len(OUTPUTS[provider]) if provider in OUTPUTS else len((options or {}).get("slots") or [])
    if len(columns) != want:
        raise MaskError("composite_wiring_inconsistent", f"{provider} gives {want} columns, {len(columns)} are bound")

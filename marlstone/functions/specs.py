"""Specifications and wishes: what a product's attributes say, and what a shopper's words ask for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .questions import spec_number

# Words that mean yes and no by themselves.
YES = ("1", "active", "available", "built in", "built-in", "enabled", "included", "on", "supported", "true", "y", "yes")
NO = ("0", "disabled", "false", "n", "no", "none", "not supported", "off", "passive", "passive isolation", "unsupported")
# For a specification the words that deny it and those that grant it.
SPEC_WORDS = {
    "anc_support": (("passive", "none", "no anc", "without anc"), ("active", "anc", "noise cancellation", "noise cancelling", "mic filtering")),
    "gps_support": (("none", "no gps", "without gps"), ("gps", "built in", "built-in", "phone connected", "phone-connected", "multi band", "multi-band")),
    "built_in_gps_support": (("phone connected", "phone-connected", "none", "no gps"), ("built in", "built-in", "multi band", "multi-band", "gps")),
    "wireless_support": ((), ("wireless", "bluetooth", "wi-fi", "wifi", "2 4ghz", "2.4ghz", "5g", "cellular")),
    "wired_support": ((), ("wired", "usb", "usb-c", "type c", "xlr", "ethernet", "hdmi", "3 5mm", "lan")),
    "usb_input": ((), ("usb", "usb-c", "type c")),
    "usb_c_input": ((), ("usb-c", "usb c", "type c")),
    "xlr_input": ((), ("xlr",)),
    "water_resistance_support": (("none", "not water", "no water"), ("water", "splash", "ipx", "atm", "resistant")),
    "oled_support": ((), ("oled",)),
    "wifi6_support": ((), ("wi-fi 6", "wifi 6", "wifi6", "ax")),
    "mesh_support": ((), ("mesh",)),
}
# Fixed value: from how many hertz a display refreshes fast.
HIGH_REFRESH = 120
# Where a specification may stand among a product's facts, first things first.
SPEC_ALIASES = {
    "ram_gb": ("ram_gb", "ram", "memory"),
    "storage_gb": ("storage_gb", "storage", "capacity"),
    "capacity_gb": ("capacity_gb", "capacity", "storage"),
    "capacity_tb": ("capacity_tb", "capacity"),
    "battery_mah": ("battery_mah", "capacity"),
    "screen_size_inch": ("screen_size_inch", "display_size_inch", "screen_size", "display"),
    "refresh_rate_hz": ("refresh_rate_hz", "refresh_rate"),
    "coverage_sqft": ("coverage_sqft", "coverage"),
    "gps_support": ("gps_support", "gps"),
    "built_in_gps_support": ("built_in_gps_support", "gps"),
    "anc_support": ("anc_support", "anc", "noise_cancellation", "noise_cancelling", "noise_canceling"),
    "inverter_support": ("inverter_support", "inverter"),
    "wireless_support": ("wireless_support", "connectivity", "wireless", "wifi_standard"),
    "wired_support": ("wired_support", "connectivity", "input", "interface", "ports"),
    "usb_input": ("usb_input", "input", "inputs", "connectivity", "interface", "ports"),
    "usb_c_input": ("usb_c_input", "input", "inputs", "connectivity", "interface", "ports", "case_charging"),
    "xlr_input": ("xlr_input", "input", "inputs", "connectivity", "interface", "ports"),
    "water_resistance_support": ("water_resistance_support", "water_resistance", "material"),
    "oled_support": ("oled_support", "display", "panel_type", "panel"),
    "wifi6_support": ("wifi6_support", "wifi_standard", "connectivity"),
    "mesh_support": ("mesh_support", "mesh", "coverage"),
    "high_refresh_support": ("high_refresh_support", "refresh_rate_hz", "refresh_rate"),
}
# How a budget is put.
BUDGET_RANGE = r"(?:between|from)\s*\$?\s*([0-9]+(?:\.[0-9]+)?)\s*(?:and|to|-)\s*\$?\s*([0-9]+(?:\.[0-9]+)?)"
BUDGET_MOST = r"(?:under|below|less than|up to|within|max|maximum|around|about|roughly|near|stretch to|can stretch to)\s*(?:\$|tk|taka|bdt)?\s*([0-9]+(?:\.[0-9]+)?)"
BUDGET_LEAST = r"(?:over|above|more than|at least|min|minimum)\s*(?:\$|tk|taka|bdt)?\s*([0-9]+(?:\.[0-9]+)?)"


def _holds_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def product_text(text: Column) -> Column:
    """Lower-cased letters, digits, plus and hyphen; all else is a space, and spaces are single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s+-]", " "), r"\s+", " "))


def spec_bool(value: Column, key: str | None = None) -> Column:
    """True, false or null: plain words first, then what the specification's own words deny or grant; any other text grants one without words."""
    text = product_text(value)
    result = F.when(text.isNull() | (text == ""), F.lit(None).cast("boolean")).when(text.isin(*NO), False).when(text.isin(*YES), True)
    if key == "high_refresh_support":
        return result.otherwise(F.coalesce(spec_number(value, "refresh_rate_hz") >= HIGH_REFRESH, F.lit(False)))
    if key in SPEC_WORDS:
        no, yes = SPEC_WORDS[key]
        return result.when(_holds_any(text, no), False).otherwise(_holds_any(text, yes))
    return result.otherwise(True)


def spec_satisfied(value: Column, key: str, operator: str, expected: bool | str | float) -> Column:
    """Whether a value meets what is asked; null never does."""
    if isinstance(expected, bool):
        met = spec_bool(value, key) == expected if operator == "eq" else F.lit(False)
    elif isinstance(expected, str):
        met = product_text(value) == product_text(F.lit(expected)) if operator == "eq" else F.lit(False)
    else:
        number = spec_number(value, key)
        met = {"eq": number == expected, "gte": number >= expected, "lte": number <= expected}.get(operator, F.lit(False))
    return F.coalesce(met, F.lit(False))


def spec_match(value: Column, key: str, expected: float) -> Column:
    """1 for just enough of a number, up to .35 less the more it exceeds what is asked; 0 for less or none."""
    number = spec_number(value, key)
    over = (number - expected) / max(expected, 1.0)
    return F.when(number.isNull() | (number < expected), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(0.35), over * 0.35)))


def spec_fact(facts: Column, key: str) -> Column:
    """What a map of facts says of a specification, under whichever of its names comes first."""
    return first_fact(facts, SPEC_ALIASES.get(key, (key,)))


def first_fact(facts: Column, aliases: tuple[str, ...]) -> Column:
    """The value of the first alias that a map of facts has."""
    return F.coalesce(*[F.try_element_at(facts, F.lit(a)) for a in aliases])


def budget(text: Column) -> Column:
    """(low, high) of the budget that a text names: a range first, then a most or a least."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    take = lambda p, g=1: F.nullif(F.regexp_extract(lower, p, g), F.lit("")).try_cast("double")
    a, b = take(BUDGET_RANGE), take(BUDGET_RANGE, 2)
    return F.struct(F.coalesce(F.least(a, b), take(BUDGET_LEAST)).alias("low"), F.coalesce(F.greatest(a, b), take(BUDGET_MOST)).alias("high"))


def unrelated_penalty(kind: Column, family: Column, category: Column, wanted_kind: str | None, wanted_family: str | None, wanted_category: str | None) -> Column:
    """What a product of another kind, family or category loses."""
    if wanted_kind:
        return F.when(kind == wanted_kind, 0.0).when(family == (wanted_family or ""), 0.04).otherwise(0.35)
    if wanted_category:
        return F.when(F.lower(category) == wanted_category.lower(), 0.0).otherwise(0.2)
    return F.lit(0.0)


def sold_out_penalty(stock: Column, needed: bool) -> Column:
    return F.when(stock.isNull() | (stock > 0), 0.0).otherwise(0.25 if needed else 0.06)


def budget_fit(price: Column, high: float | None, thrifty: bool = False) -> Column:
    if high is None and not thrifty:
        return F.lit(0.0)
    fit = 1.0 - price / high * 0.35 if high else 1.0 / (1.0 + F.greatest(price, F.lit(0.0)) / 1000.0)
    return F.when(price.isNull(), 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fit)))


#: The weights of a product's features, and those of three of them where the question names specifications.
PRODUCT_WEIGHTS = {
    "semantic": 0.15, "lexical": 0.14, "exact_name": 0.12, "exact_sku": 0.14, "kind": 0.18, "family": 0.08, "category": 0.08, "brand": 0.05, "price_fit": 0.07, "stock_fit": 0.03, "metadata": 0.04,
    "spec": 0.18, "premium": 0.02, "budget": 0.03, "unrelated": -1.0, "sold_out": -1.0,
}
SPEC_WEIGHTS = {"semantic": 0.12, "lexical": 0.12, "spec": 0.28}


def product_score(features: dict[str, Column], by_spec: bool = False) -> Column:
    """The weighted sum of a product's features, between 0 and 1, to four places; features that aren't given count nothing."""
    weights = PRODUCT_WEIGHTS | (SPEC_WEIGHTS if by_spec else {})
    total = F.lit(0.0)
    for name, value in features.items():
        total = total + F.coalesce(value.cast("double"), F.lit(0.0)) * weights[name]
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)

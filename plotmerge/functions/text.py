"""Fields read from free text, and small text conversions.

Patterns carry ``(?U)`` so that ``\\s``, ``\\d`` and ``\\b`` are Unicode-aware: a
no-break space inside "415 000 EUR" is a space. No pattern can backtrack over a
long run of digits or spaces, so a scan over a page is linear in its length.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotmerge.functions.binding import let
from plotmerge.schemas import EPC_LABELS

# ---- fixed values: what the fields look like in text -----------------------
BEDROOMS_PATTERN = r"(?iU)(\d+)\s*slaapkamer"
SURFACE_PATTERN = r"(?iU)(\d{2,4})\s*m\s*[²2]"
SURFACE_RANGE = (20, 2000)
EURO_SIGN = r"€|(?i)(?<!\p{L})EUR(?!\p{L})"
AMOUNT = r"(?U)^[\d\s.,]+"
AMOUNT_AFTER_SIGN = r"(?U)^\s*(\d[\d\s.,]*)"
PRICE_RANGE = (1_000, 100_000_000)
EPC_LABEL_PATTERN = r"(?U)\bEPC[^A-Z]{0,30}([A-F]\+?)\b"
EPC_KWH_PATTERN = r"(?iU)(\d{2,4})\s*kWh\s*/\s*m"
TYPE_RULES = (
    ("appartement", "appartement"),
    ("studio", "appartement"),
    ("huis", "huis"),
    ("woning", "huis"),
    ("villa", "huis"),
    ("grond", "grond"),
    ("bouwgrond", "grond"),
)
CONDITION_RULES = (
    ("nieuwbouw", "nieuwbouw"),
    ("renoveren", "te-renoveren"),
    ("renovatie", "te-renoveren"),
    ("instapklaar", "instapklaar"),
)
# ----------------------------------------------------------------------------

WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
DOUBLE_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_of(text: Column) -> Column:
    """``strip`` of a column: a text that begins and ends with a plain character stays as it is."""

    def plain(char: Column) -> Column:
        return F.ascii(char).between(ord("!"), ord("~"))

    return F.when(plain(text) & plain(F.right(text, F.lit(1))), text).otherwise(strip(text))


def blank_to_null(text: Column) -> Column:
    return _without(strip(text), "")


def _without(value: Column, nothing) -> Column:
    """``nullif`` that names the value once, and is compiled."""
    return F.get(F.array_remove(F.array(value), F.lit(nothing)), F.lit(0))


def parse_int_eu(text: Column) -> Column:
    """Keep the digits, whatever separates them; NULL without any."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return digits.try_cast("bigint")


def first_str(text: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, group))


def first_int(text: Column, pattern: str, group: int = 1) -> Column:
    return parse_int_eu(F.regexp_extract(text, pattern, group))


def bedrooms(text: Column) -> Column:
    return first_int(text, BEDROOMS_PATTERN)


def surface(text: Column) -> Column:
    """Largest plausible number written before a square-metre sign."""
    low, high = SURFACE_RANGE
    found = F.transform(F.regexp_extract_all(text, F.lit(SURFACE_PATTERN), F.lit(1)), parse_int_eu)
    return F.array_max(F.filter(found, lambda n: n.between(low, high)))


def price(text: Column) -> Column:
    """First plausible amount: those before a euro sign, else those after one.

    The text is cut at the signs, and only the ends of the pieces are matched: the
    end before a sign is read backwards, from the sign on.
    """
    low, high = PRICE_RANGE

    def first_plausible(amounts: Column) -> Column:
        found = F.filter(F.transform(amounts, parse_int_eu), lambda n: n.between(low, high))
        return F.get(found, F.lit(0))

    def read(pieces: Column) -> Column:
        signs = F.size(pieces) - 1
        before = F.transform(
            F.slice(pieces, 1, signs),
            lambda p: F.reverse(F.regexp_extract(F.reverse(p), AMOUNT, 0)),
        )
        after = F.transform(
            F.slice(pieces, 2, signs), lambda p: F.regexp_extract(p, AMOUNT_AFTER_SIGN, 1)
        )
        return F.coalesce(first_plausible(before), first_plausible(after))

    return let(F.split(text, EURO_SIGN), read)


def epc_label_in(text: Column) -> Column:
    return first_str(text, EPC_LABEL_PATTERN)


def epc_kwh_in(text: Column) -> Column:
    return first_int(text, EPC_KWH_PATTERN)


def epc_exact(text: Column) -> Column:
    """The label itself, after trimming and upper-casing, or NULL."""
    return let(F.upper(strip(text)), _label)


def epc_lenient(text: Column) -> Column:
    """The exact label, else a leading letter A to F ("B 120" is B)."""
    return let(
        F.upper(strip(text)),
        lambda t: F.coalesce(_label(t), F.nullif(F.regexp_extract(t, "^[A-F]", 0), F.lit(""))),
    )


def _label(text: Column) -> Column:
    return F.when(text.isin(*EPC_LABELS), text)


def by_rules(text: Column, rules, default: str | None = None) -> Column:
    """Value of the first rule whose word occurs in the lower-cased text."""


    def first_hit(lowered: Column) -> Column:
        out = F
        for word, value in rules:
            out = out.when(lowered.contains(word), F.lit(value))
        return out.otherwise(F.lit(default).cast("string"))

    return let(F.lower(text), first_hit)


def property_type(text: Column) -> Column:
    return by_rules(F.coalesce(text, F.lit("")), TYPE_RULES, "other")


def condition(text: Column) -> Column:
    return by_rules(text, CONDITION_RULES)


def float_plain(text: Column) -> Column:
    """Number with a decimal point, or NULL (Java's "1d" is not a number)."""
    return let(strip(text), lambda t: F.when(t.rlike(DOUBLE_PATTERN), t.try_cast("double")))


def float_comma(text: Column) -> Column:
    """As float_plain; a decimal comma is accepted."""
    return float_plain(F.replace(text, F.lit(","), F.lit(".")))


def city_from_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def street(name: Column, number: Column) -> Column:
    """Street and number, skipping what is empty; NULL if both are."""
    return blank_to_null(
        F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(number, F.lit("")))
    )


def first_nonzero(*numbers: Column) -> Column:
    """First number that is neither NULL nor 0; the last one counts as it is."""
    *head, last = numbers
    return F.coalesce(*[_without(n, 0) for n in head], last)


def first_nonempty(*texts: Column) -> Column:
    """First text that is neither NULL nor ''; the last one counts as it is."""
    *head, last = texts
    return F.coalesce(*[_without(t, "") for t in head], last)


def int_or_null(text: Column) -> Column:
    """A blank or unreadable query parameter is no parameter."""
    return blank_to_null(text).try_cast("int")


def timestamp_or_null(text: Column) -> Column:
    return text.try_cast("timestamp")


def price_display(amount: Column, unknown: str = "onbekend", zero_is_unknown: bool = True) -> Column:
    """Thousands separated by dots; the list also shows 0 as unknown, the map does not."""
    shown = F.translate(F.format_number(amount, 0), ",", ".")
    missing = amount.isNull() | (amount == 0) if zero_is_unknown else amount.isNull()
    return F.when(missing, F.lit(unknown)).otherwise(shown)


# ---- entities ---------------------------------------------------------------


def unescape(text: Column) -> Column:
    """Decode character references: HTML names, decimal and hexadecimal numbers.

    A decoded ampersand is put in last, so "&amp;lt;" becomes "&lt;" and no more.
    """
    # One constant, folded once, not thousands of literals.
    table = {name[:-1]: text for name, text in html5.items() if name.endswith(";") and name != "amp;"}
    names = F.from_json(F.lit(json.dumps(table)), "map<string,string>")

    def numbered(base: int, value: Column) -> Column:
        def char(point: Column) -> Column:
            is_char = ((point > 0) & (point < 0xD800)) | point.between(0xE000, 0x10FFFF)
            code = F.when(is_char, point).otherwise(0xFFFD)
            return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

        # Leading zeros say nothing; seven digits left are beyond any character.
        digits = F.substring(F.regexp_replace(value, "^0+(?=.)", ""), 1, 8)
        return let(F.conv(digits, base, 10).cast("bigint"), char)

    def each(acc: Column, pattern: str, left: str, value) -> Column:
        return let(
            acc,
            lambda t: F.aggregate(
                F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1))),
                t,
                lambda done, found: F.replace(
                    done, F.concat(F.lit(left), found, F.lit(";")), value(found)
                ),
            ),
        )

    def decoded(t: Column) -> Column:
        out = each(
            t,
            r"&(?!amp;)([A-Za-z][A-Za-z0-9]*);",
            "&",
            lambda n: F.coalesce(F.try_element_at(names, n), F.concat(F.lit("&"), n, F.lit(";"))),
        )
        out = each(out, r"&#(?!0*38;)([0-9]+);", "&#", lambda n: numbered(10, n))
        out = each(out, r"&#x(?!0*26;)([0-9A-Fa-f]+);", "&#x", lambda n: numbered(16, n))
        out = each(out, r"&#X(?!0*26;)([0-9A-Fa-f]+);", "&#X", lambda n: numbered(16, n))
        return F.regexp_replace(out, r"&(?:amp|#0*38|#[xX]0*26);", "&")

    return let(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


# ---- keys -------------------------------------------------------------------

_NOT_KEY = re.compile(r"[^a-z0-9]")


def _key_of(text: str | None) -> str:
    if text is None:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
    return _NOT_KEY.sub("", text.lower())


@F.pandas_udf(T.StringType())
def address_key(text: pd.Series) -> pd.Series:
    """Compatibility-decomposed, ASCII only, lower case, letters and digits; NULL is ''."""
    return text.map(_key_of)


@F.pandas_udf(T.StringType())
def _blake2b_hex(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashlib.blake2b(t.encode("utf-8"), digest_size=16).hexdigest())


def fingerprint(source_name: Column, source_id: Column, mode: str = "md5") -> Column:
    """128-bit hex key of one advert of one source.

    ``md5`` stays inside the JVM; ``blake2b`` equals stores keyed with BLAKE2b-128.
    """
    joined = F.concat_ws(":", source_name, source_id)
    if mode == "md5":
        return F.md5(joined)
    if mode == "blake2b":
        return _blake2b_hex(joined)
    raise ValueError(f"unknown fingerprint mode {mode!r}")

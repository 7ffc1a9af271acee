"""From landed pages to candidate listings, one scan for all sources.

Each layout says where its fields are. The layouts run side by side in one
projection: ``CASE source_name`` picks the expression, so the page body is read
and matched once, the JSON of a block is parsed once, and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmerge.functions import json_values as J
from plotmerge.functions import markup as M
from plotmerge.functions import text as X
from plotmerge.functions.binding import let
from plotmerge.functions.urls import UrlGrammar
from plotmerge.sources.registry import SOURCES, SourceSpec

# ---- fixed values ----------------------------------------------------------
RESIDENCE_TYPES = (
    "Residence",
    "RealEstateListing",
    "SingleFamilyResidence",
    "Apartment",
    "House",
)
UNKNOWN_CITY = "?"
DESCRIPTION_LIMIT = 500
# Code tables of the classified layout; hand other ones to extract_candidates.
SUBTYPE_TO_TYPE = {
    "HOUSE": "huis",
    "VILLA": "huis",
    "APARTMENT": "appartement",
    "STUDIO": "appartement",
    "LAND": "grond",
    "BUILDING_LAND": "grond",
}
BUILDING_CONDITION = {
    "NEW": "nieuwbouw",
    "AS_NEW": "instapklaar",
    "JUST_RENOVATED": "instapklaar",
    "GOOD": "instapklaar",
    "TO_BE_DONE_UP": "te-renoveren",
    "TO_BE_RENOVATED": "te-renoveren",
    "TO_RENOVATE": "te-renoveren",
    "TO_RESTORE": "te-renoveren",
}
# ----------------------------------------------------------------------------

# Objects a layout may take out of the page before its fields are read.
SLOTS = ("main", "house", "address", "geo", "state")
_PLACE = ("address.streetAddress", "address.postalCode", "address.addressLocality", "geo.latitude", "geo.longitude")
# What the layouts read of them, each object in one pass.
OPENED = {
    "main": (
        *_PLACE, "@type", "name", "description", "url", "offers", "floorSize.value", "numberOfRooms",
        "energyEfficiencyScaleMin", "energyConsumption", "image", "sku", "title", "id", "address.street",
        "address.houseNumber", "address.number", "address.city", "address.locality", "location.latitude",
        "location.longitude", "price", "subType", "buildingCondition", "habitableSurface", "netHabitableSurface",
        "surface", "bedrooms", "bedroomCount", "epc.label", "epc.consumption", "epcLabel", "epcScore", "media.photos",
    ),
    "house": (*_PLACE, "name", "description", "image"),
    "address": ("streetAddress", "postalCode", "addressLocality"),
    "geo": ("latitude", "longitude"),
    "state": ("address.geo.lat", "address.geo.long"),
}


@dataclass(frozen=True)
class Page:
    """Columns a layout may refer to.

    ``nodes`` are as of ``markup.typed``, ``slot`` has VARIANT objects, and ``opened`` what
    ``OPENED`` names of them, as columns.
    """

    html: Column
    url: Column
    tags: Column
    nodes: Column
    metas: Column
    slot: Mapping[str, Column]
    opened: Mapping[str, Column]
    grammar: UrlGrammar


@dataclass(frozen=True)
class Layout:
    """Expressions of a layout, in three steps that each see the step before.

    ``slots`` are objects of the page, ``fields`` the listing columns, ``reject``
    the reason why there is no listing.
    """

    slots: dict[str, Column] = field(default_factory=dict)
    late_slots: dict[str, Column] = field(default_factory=dict)
    fields: dict[str, Column] = field(default_factory=dict)
    reject: Column | None = None


def code(value: Column, table: Mapping[str, str]) -> Column:
    """Look a code up in a small constant table; unknown codes are NULL."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.upper(X.strip(value)))


def _address(node: Column) -> tuple[Column, Column, Column]:
    return (
        X.blank_to_null(J.text_of(node["streetAddress"])),
        J.int_of(node["postalCode"]),
        X.blank_to_null(J.text_of(node["addressLocality"])),
    )


def _reject(*rules: tuple[Column, str]) -> Column:
    """The first failing rule, in order; a NULL condition is no failure."""
    out = None
    for failed, reason in rules:
        out = F.when(failed, F.lit(reason)) if out is None else out.when(failed, F.lit(reason))
    return out


def _image(value: Column) -> Column:
    """URL of an image given as text, as a list, or as an object with a url."""
    return let(
        J.first_or_self(value),
        lambda v: X.strip(F.coalesce(J.string_of(v), J.as_string(J.child(v, "url")))),
    )


def _texts(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def _told(description: Column, name: Column) -> Column:
    """Text that the condition is read from: the description, a title only without one."""
    return F.coalesce(X.blank_to_null(description), name)


def residence(p: Page) -> Layout:
    """One linked-data object of a residence-like type has everything.

    The advert is the one that the object's own URL names; the page's URL counts only
    where the object has none.
    """
    main = p.opened["main"]
    street, postcode, city = _address(main["address"])
    name = X.strip(J.string_of(main["name"]))
    description = X.strip(J.string_of(main["description"]))
    # A node is found by its type, so that is a string.
    kind = J.string_of(main["@type"])
    declared = F.coalesce(X.blank_to_null(J.string_of(main["url"])), p.url)
    geo = main["geo"]
    return Layout(
        slots={"main": M.typed_node(p.nodes, *RESIDENCE_TYPES)},
        fields={
            "source_id": p.grammar.advert_id(declared),
            "source_url": declared,
            "postcode": postcode,
            "gemeente": city,
            "straat": street,
            "lat": J.float_of(geo["latitude"]),
            "lng": J.float_of(geo["longitude"]),
            "prijs_eur": J.as_int(J.child(J.first_or_self(main["offers"]), "price")),
            "type": X.property_type(_texts(kind, name)),
            "oppervlakte_bewoonbaar_m2": J.int_of(main["floorSize"]["value"]),
            "slaapkamers": J.int_of(main["numberOfRooms"]),
            "epc_label": X.epc_exact(J.string_of(main["energyEfficiencyScaleMin"])),
            "epc_kwh": J.int_of(main["energyConsumption"]),
            "staat": X.condition(_told(description, name)),
            "titel": name,
            "korte_beschrijving": description,
            "hoofd_foto_url": _image(main["image"]),
        },
        reject=_reject(
            (main.isNull(), "no_residence_block"),
            (F.isnull("postcode"), "no_postcode"),
            (F.isnull("gemeente"), "no_city"),
            (F.isnull("source_id"), "no_id_in_url"),
        ),
    )


def product_house(p: Page) -> Layout:
    """Product and House blocks; the page state has the trusted coordinates.

    What a Product can tell (name, description, image, price) is not looked for in the
    House or the page. Without a city the URL must be an advert's.
    """
    product, house, state = p.opened["main"], p.opened["house"], p.opened["state"]
    street, postcode, city = _address(house["address"])
    url_postcode = p.grammar.postcode(p.url)

    def main(key: str) -> Column:
        return F.when(product.isNull(), house[key]).otherwise(product[key])

    name = X.strip(J.string_of(main("name")))
    description = X.strip(J.string_of(main("description")))
    offer = J.first_or_self(product["offers"])
    declared = F.coalesce(X.blank_to_null(J.as_string(J.child(offer, "url"))), p.url)
    advert = F.coalesce(
        X.blank_to_null(J.text_of(product["sku"])), p.grammar.advert_id(declared)
    )

    def coordinate(state_key: str, house_key: str) -> Column:
        return F.coalesce(
            J.float_of(state["address"]["geo"][state_key], comma=True),
            J.float_of(house["geo"][house_key], comma=True),
        )

    price = J.as_int(J.child(offer, "price"))
    label = X.epc_lenient(X.epc_label_in(p.html))
    return Layout(
        slots={
            "main": M.typed_node(p.nodes, "Product"),
            "house": M.typed_node(p.nodes, "House"),
            "state": M.page_property(p.tags),
        },
        fields={
            "source_id": advert,
            "source_url": declared,
            "postcode": F.coalesce(postcode, url_postcode),
            "gemeente": F.coalesce(city, F.lit(UNKNOWN_CITY)),
            "straat": street,
            "lat": coordinate("lat", "latitude"),
            "lng": coordinate("long", "longitude"),
            "prijs_eur": price,
            "type": X.property_type(_texts(name, description)),
            "oppervlakte_bewoonbaar_m2": X.surface(p.html),
            "slaapkamers": X.bedrooms(p.html),
            "epc_label": label,
            "epc_kwh": X.epc_kwh_in(p.html),
            "staat": X.condition(_told(description, name)),
            "titel": name,
            "korte_beschrijving": F.substring(description, 1, DESCRIPTION_LIMIT),
            "hoofd_foto_url": _image(main("image")),
        },
        reject=_reject(
            (product.isNull() & house.isNull(), "no_product_or_house_block"),
            (F.isnull("postcode"), "no_postcode"),
            (city.isNull() & ~p.grammar.matches(p.url), "no_city"),
            (F.isnull("source_id"), "no_id"),
        ),
    )


def split_blocks(p: Page) -> Layout:
    """Address, coordinates and text in blocks of their own; specs in meta text."""
    address, geo, house = p.opened["address"], p.opened["geo"], p.opened["house"]
    og_title = M.meta_content(p.metas, "og:title")
    spec = _texts(M.meta_content(p.metas, "twitter:description", "name"),
                  M.meta_content(p.metas, "twitter:description"), og_title)
    street, _, city = _address(address)
    description = X.strip(J.string_of(house["description"]))
    advert = p.grammar.advert_id(p.url)

    def spec_first(read) -> Column:
        return X.first_nonzero(read(spec), read(p.html))

    return Layout(
        slots={
            "address": M.typed_node(p.nodes, "PostalAddress"),
            "geo": M.typed_node(p.nodes, "GeoCoordinates"),
            "house": M.typed_node(p.nodes, "House"),
        },
        fields={
            "source_id": advert,
            "source_url": p.url,
            "postcode": p.grammar.postcode(p.url),
            "gemeente": F.coalesce(city, p.grammar.city(p.url)),
            "straat": street,
            "lat": J.float_of(geo["latitude"], comma=True),
            "lng": J.float_of(geo["longitude"], comma=True),
            "prijs_eur": spec_first(X.price),
            "type": X.property_type(spec),
            "oppervlakte_bewoonbaar_m2": spec_first(X.surface),
            "slaapkamers": spec_first(X.bedrooms),
            "epc_label": X.epc_lenient(X.epc_label_in(p.html)),
            "epc_kwh": X.epc_kwh_in(p.html),
            "staat": X.condition(_told(description, og_title)),
            "titel": F.coalesce(og_title, F.lit("")),
            "korte_beschrijving": F.substring(description, 1, DESCRIPTION_LIMIT),
            "hoofd_foto_url": M.meta_content(p.metas, "og:image"),
        },
        reject=_reject((F.isnull("source_id"), "url_not_parseable")),
    )


def classified(
    p: Page,
    subtypes: Mapping[str, str] = SUBTYPE_TO_TYPE,
    conditions: Mapping[str, str] = BUILDING_CONDITION,
) -> Layout:
    """Everything is in the classified object of the page state."""
    state, main = p.slot["state"], p.opened["main"]
    address = main["address"]
    name = X.strip(J.string_of(main["title"]))
    description = X.strip(J.string_of(main["description"]))

    def first_int(*values: Column) -> Column:
        return X.first_nonzero(*[J.int_of(v) for v in values])

    postcode = J.int_of(address["postalCode"])
    city = X.blank_to_null(
        X.first_nonempty(
            J.text_of(address["city"]), J.text_of(address["locality"])
        )
    )
    advert = X.blank_to_null(J.text_of(main["id"]))
    number = X.first_nonempty(
        J.text_of(address["houseNumber"]), J.text_of(address["number"])
    )
    photos, price = main["media"]["photos"], main["price"]
    label = J.string_of(F.coalesce(main["epc"]["label"], main["epcLabel"]))
    return Layout(
        slots={"state": M.page_state(p.tags)},
        late_slots={"main": M.classified(state)},
        fields={
            "source_id": advert,
            "source_url": F.coalesce(X.blank_to_null(J.string_of(main["url"])), p.url),
            "postcode": postcode,
            "gemeente": city,
            "straat": X.street(J.text_of(address["street"]), number),
            "lat": J.float_of(main["location"]["latitude"]),
            "lng": J.float_of(main["location"]["longitude"]),
            "prijs_eur": first_int(J.child(price, "mainValue"), J.child(price, "value"), price),
            "type": F.coalesce(
                code(J.string_of(main["subType"]), subtypes), X.property_type(name)
            ),
            "oppervlakte_bewoonbaar_m2": first_int(
                main["habitableSurface"], main["netHabitableSurface"], main["surface"]
            ),
            "slaapkamers": first_int(main["bedrooms"], main["bedroomCount"]),
            "epc_label": X.epc_exact(label),
            "epc_kwh": first_int(main["epc"]["consumption"], main["epcScore"]),
            "staat": F.coalesce(
                code(J.string_of(main["buildingCondition"]), conditions),
                X.condition(_told(description, name)),
            ),
            "titel": name,
            "korte_beschrijving": description,
            "hoofd_foto_url": F.coalesce(_image(photos), _image(main["image"])),
        },
        reject=_reject(
            (state.isNull(), "no_page_state"),
            (main.isNull(), "no_classified"),
            (F.isnull("postcode"), "no_postcode"),
            (F.isnull("gemeente"), "no_city"),
            (F.isnull("source_id"), "no_id"),
        ),
    )


LAYOUTS = {
    "residence": residence,
    "product_house": product_house,
    "split_blocks": split_blocks,
    "classified": classified,
}

CANDIDATE_FIELDS = {
    "source_id": "string",
    "source_url": "string",
    "postcode": "int",
    "gemeente": "string",
    "straat": "string",
    "lat": "double",
    "lng": "double",
    "prijs_eur": "bigint",
    "type": "string",
    "oppervlakte_bewoonbaar_m2": "bigint",
    "slaapkamers": "bigint",
    "epc_label": "string",
    "epc_kwh": "bigint",
    "staat": "string",
    "titel": "string",
    "korte_beschrijving": "string",
    "hoofd_foto_url": "string",
}


def page_text(body: Column) -> Column:
    """Page bytes as text; invalid UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(body.cast("string"))


def extract_candidates(
    pages: DataFrame,
    sources: Mapping[str, SourceSpec] = SOURCES,
    layouts: Mapping = LAYOUTS,
) -> DataFrame:
    """Candidate rows of all pages: key columns, listing fields and ``reject``.

    Pages of sources not in the mapping are left out. A page that cannot be read
    keeps its row, with the reason in ``reject``.
    """
    declared = {n: s for n, s in sources.items() if s.custom_extract is None}
    custom = [s for s in sources.values() if s.custom_extract is not None]
    parts = []
    if declared:
        parts.append(_extract_declared(pages, declared, layouts))
    for spec in custom:
        parts.append(spec.custom_extract(pages.where(F.col("source_name") == spec.name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _chosen(specs: tuple[SourceSpec, ...], layouts) -> dict[str, dict[str, Column]]:
    """Per step and name, the expression that picks the row's own layout."""
    made = {
        spec.name: layouts[spec.layout](
            Page(
                html=F.col("_html"),
                url=F.col("ref_url"),
                nodes=F.col("_nodes"),
                tags=F.col("_tags"),
                metas=F.col("_metas"),
                slot={s: F.col(f"_{s}") for s in SLOTS},
                opened={s: F.col(f"_{s}_opened") for s in SLOTS},
                grammar=spec.grammar,
            )
        )
        for spec in specs
    }

    def choose(pick, dtype: str) -> Column:
        out = F
        for name, layout in made.items():
            value = pick(layout)
            if value is not None:
                out = out.when(F.col("source_name") == name, value)
        return F.lit(None).cast(dtype) if out is F else out.cast(dtype)

    return {
        "slots": {s: choose(lambda la, s=s: la.slots.get(s), "variant") for s in SLOTS},
        "late": {s: choose(lambda la, s=s: la.late_slots.get(s), "variant") for s in SLOTS},
        "fields": {
            f: choose(lambda la, f=f: la.fields.get(f), t) for f, t in CANDIDATE_FIELDS.items()
        },
        "reject": {"reject": choose(lambda la: la.reject, "string")},
    }


# Expressions name columns and nothing else, so they serve every DataFrame.
_chosen_standard = lru_cache(maxsize=16)(lambda specs: _chosen(specs, LAYOUTS))


def _extract_declared(pages: DataFrame, specs: Mapping[str, SourceSpec], layouts) -> DataFrame:
    known = tuple(specs.values())
    step = _chosen_standard(known) if layouts is LAYOUTS else _chosen(known, layouts)
    read = pages.where(F.col("source_name").isin(*specs)).select(
        "source_name",
        F.col("source_url").alias("ref_url"),
        "fetched_at",
        page_text(F.col("body")).alias("_html"),
    )
    keys = ["source_name", "ref_url", "fetched_at", "_html"]
    slots = [f"_{s}" for s in SLOTS]
    tagged = read.withColumn("_tags", M.tags(F.col("_html")))
    noded = tagged.select(
        *keys,
        "_tags",
        M.typed(M.ld_nodes(M.json_ld(F.col("_tags")))).alias("_nodes"),
        M.metas(F.col("_tags")).alias("_metas"),
    )
    slotted = noded.select(*keys, "_metas", *[c.alias(f"_{s}") for s, c in step["slots"].items()])
    slotted = slotted.select(
        *keys, "_metas", *[F.coalesce(f"_{s}", c).alias(f"_{s}") for s, c in step["late"].items()]
    )
    opened = slotted.select(
        "*",
        *[
            J.opened(F.col(f"_{s}"), *[tuple(path.split(".")) for path in paths]).alias(f"_{s}_opened")
            for s, paths in OPENED.items()
        ],
    )
    slots += [f"{s}_opened" for s in slots]
    filled = opened.select(*keys, *slots, *[c.alias(f) for f, c in step["fields"].items()])
    judged = filled.withColumns(step["reject"])
    # Through inline() a filter on a parsed column stays above the parsing; a plain
    # projection would let the optimizer copy the whole parse into the filter.
    # Filters on the key columns still reach the scan.
    return judged.select(*keys[:3], F.inline(F.array(F.struct(*CANDIDATE_FIELDS, "reject"))))

"""URL parts and the advert URL grammars of the sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotmerge.functions.binding import let
from plotmerge.functions.text import city_from_slug


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def scheme(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PROTOCOL"))


def path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def query(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"))


def written_scheme(url: Column) -> Column:
    """The lower-case scheme as it is written, '' if there is none; no URL is malformed."""
    return F.regexp_extract(url, "^([a-z]+)://", 1)


def written_authority(url: Column) -> Column:
    """What stands between the scheme and the path, with user and port."""
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def written_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1)


def is_http_url(url: Column) -> Column:
    """http or https with a host; NULL in, NULL out."""
    return url.rlike(r"(?i)^https?://[^\s/?#]+(?:[/?#]\S*)?$")


SEPARATOR = "\x01"


class UrlGrammar:
    """One source's advert URLs: a pattern and which groups mean what."""

    def __init__(self, pattern: str, postcode: int, city: int, advert: int, must_contain: str = ""):
        self.pattern = pattern
        self.groups = {"postcode": postcode, "city": city, "advert": advert}
        self.must_contain = must_contain

    def matches(self, url: Column) -> Column:
        hit = url.rlike(self.pattern)
        return hit & F.contains(url, F.lit(self.must_contain)) if self.must_contain else hit

    def group(self, url: Column, name: str) -> Column:
        value = F.regexp_extract(url, self.pattern, self.groups[name])
        return F.when(self.matches(url), F.nullif(value, F.lit("")))

    def parse(self, url: Column) -> Column:
        """(postcode, gemeente, source_id) of a URL that fits, else NULL.

        One match: the URL is rewritten to its three parts, or stays as it is.
        """

        order = [self.groups[n] for n in ("postcode", "city", "advert")]
        rewritten = F.regexp_replace(url, "^.*?" + self.pattern, SEPARATOR.join(f"${g}" for g in order))

        def of_parts(p: Column) -> Column:
            found = F.struct(
                F.get(p, F.lit(0)).cast("int").alias("postcode"),
                city_from_slug(F.get(p, F.lit(1))).alias("gemeente"),
                F.get(p, F.lit(2)).alias("source_id"),
            )
            return F.when((F.size(p) == 3) & F.contains(url, F.lit(self.must_contain)), found)

        return let(F.split(rewritten, SEPARATOR), of_parts)

    def postcode(self, url: Column) -> Column:
        return self.group(url, "postcode").cast("int")

    def advert_id(self, url: Column) -> Column:
        return self.group(url, "advert")

    def city(self, url: Column) -> Column:
        return city_from_slug(self.group(url, "city"))


# ---- fixed values: advert URL grammars -------------------------------------
# anchored at the end, free at the start
DATED_PATH = UrlGrammar(
    r"(?i)/(\d{4})-([^/]+)/(?:[^/]+/)*?(\d+)(?:-[^/]*)?/?$", 1, 2, 3, must_contain="te-koop"
)
SALE_PATH = UrlGrammar(r"/te-koop/(\d{4})-([^/]+)/(\d+)/?$", 1, 2, 3)
DETAIL_PATH = UrlGrammar(r"(?i)/nl/detail/[^/]+/te-koop/(\d{4})/([^/]+)/([a-z0-9]+)/?$", 1, 2, 3)
CLASSIFIED_PATH = UrlGrammar(
    r"(?i)/nl/classified/[^/]+/te-koop/([^/]+)/(\d{4})/(\d+)/?$", 2, 1, 3
)
# ----------------------------------------------------------------------------

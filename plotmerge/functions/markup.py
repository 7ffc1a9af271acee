"""Structured data embedded in page markup.

``tags`` walks the page once: comments, script elements and meta elements in
document order. Everything else here works on that short array, so the page body
is matched by one pattern only and can be dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotmerge.functions import json_values as J
from plotmerge.functions.binding import let
from plotmerge.functions.text import blank_to_null, unescape

_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TAGS = (
    # What is not closed runs to the end of the page, so each character is read once.
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<script\b{_ATTRS}>.*?(?:</script|\z)"
    rf"|<style\b{_ATTRS}>.*?(?:</style|\z)"
    rf"|<meta\b{_ATTRS}>"
)
_OPEN_SCRIPT = rf"(?is)^<script\b{_ATTRS}>"


def tags(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_TAGS), F.lit(0))


def _has_attr(tag: Column, name: str, value: str) -> Column:
    quoted = value.replace("/", r"\/").replace("+", r"\+").replace(".", r"\.")
    return tag.rlike(rf"(?is)^<\w++{_ATTRS_BEFORE}\s{name}\s*=\s*(?:\"{quoted}\"|'{quoted}'|{quoted}(?=[\s>]))")


# Attributes before the wanted one, each taken whole.
_ATTRS_BEFORE = r"(?:\s+[^\s=>\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*?"


def scripts(tag_array: Column) -> Column:
    """Script elements with their opening tag, comments excluded."""
    return F.filter(tag_array, lambda t: F.lower(F.substring(t, 1, 7)) == "<script")


def script_body(tag: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(tag, _OPEN_SCRIPT, ""), r"(?i)</script$", ""
    )


def json_ld(tag_array: Column) -> Column:
    """All linked-data objects: malformed blocks are skipped, lists are flattened."""
    bodies = F.transform(
        F.filter(scripts(tag_array), lambda t: _has_attr(t, "type", "application/ld+json")),
        lambda t: J.parse_strict(script_body(t)),
    )
    lists = F.transform(
        F.filter(bodies, lambda v: v.isNotNull()),
        lambda v: F.coalesce(J.items(v), F.array(v)),
    )
    return F.filter(F.flatten(lists), J.is_object)


def ld_nodes(blocks: Column) -> Column:
    """Each block followed by the objects of its @graph, in document order."""
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.concat(
                F.array(b),
                F.coalesce(
                    F.filter(J.items(J.child(b, "@graph")), J.is_object),
                    F.array().cast("array<variant>"),
                ),
            ),
        )
    )


def typed(nodes: Column) -> Column:
    """The nodes as (type, node): their @type in lower case, read once for all look-ups."""
    return F.transform(
        nodes,
        lambda n: F.struct(F.lower(J.as_string(J.child(n, "@type"))).alias("type"), n.alias("node")),
    )


def typed_node(typed_nodes: Column, *wanted: str) -> Column:
    """First node of ``typed`` whose @type is the first of these strings that occurs, in any case."""

    def first(kind: str) -> Column:
        return F.get(F.filter(typed_nodes, lambda t: t["type"] == kind.lower()), F.lit(0))["node"]

    return F.coalesce(*[first(w) for w in wanted])


def node_of_type(nodes: Column, wanted: str) -> Column:
    """First node whose @type is that string, in any case."""
    return typed_node(typed(nodes), wanted)


def node_of_types(nodes: Column, wanted) -> Column:
    """node_of_type for the first type of the list that occurs."""
    return let(typed(nodes), lambda t: typed_node(t, *wanted))


def page_state(tag_array: Column, element_id: str = "__NEXT_DATA__") -> Column:
    """Object in the script with the page-state id, or NULL."""
    found = F.get(
        F.filter(scripts(tag_array), lambda t: _has_attr(t, "id", element_id)), F.lit(0)
    )
    return J.object_only(J.parse_strict(script_body(found)))


def page_property(tag_array: Column) -> Column:
    """``props.pageProps.property`` of the first script that parses and has it."""
    candidates = F.filter(
        scripts(tag_array), lambda t: t.contains("pageProps") & t.contains("property")
    )
    found = F.transform(
        candidates,
        lambda t: J.object_only(
            J.child(J.parse_strict(script_body(t)), "props", "pageProps", "property")
        ),
    )
    return F.get(F.array_compact(found), F.lit(0))


def classified(state: Column) -> Column:
    """The advert object inside a page state, wherever the layout keeps it."""
    places = (("props", "pageProps", "classified"), ("classified",), ("listing",), ("property",))
    return F.coalesce(*[J.object_only(J.child(state, *p)) for p in places])


def _attr(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, in any quoting; NULL if absent."""
    value = r"(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    written = F.regexp_extract(tag, rf"(?is)^<\w++{_ATTRS_BEFORE}\s{name}\s*=\s*{value}", 1)
    return let(
        written,
        lambda w: F.when(w.rlike("^[\"']"), F.substr(w, F.lit(2), F.length(w) - 2)).when(w != "", w),
    )


def metas(tag_array: Column) -> Column:
    """All meta elements as (name, property, content), content trimmed and decoded."""
    elements = F.filter(tag_array, lambda t: F.lower(F.substring(t, 1, 5)) == "<meta")
    return F.transform(
        elements,
        lambda t: F.struct(
            _attr(t, "name").alias("name"),
            _attr(t, "property").alias("property"),
            blank_to_null(unescape(_attr(t, "content"))).alias("content"),
        ),
    )


def meta_content(meta_array: Column, key: str, attr: str = "property") -> Column:
    """Content of the first of ``metas`` whose attribute is the key; NULL if empty."""
    return F.get(F.filter(meta_array, lambda m: m[attr] == key), F.lit(0))["content"]


def title(html: Column) -> Column:
    return blank_to_null(
        unescape(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1))
    )


def html_lang(html: Column) -> Column:
    return blank_to_null(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1))


# ---- heads by their plain spelling -------------------------------------------
# What Unicode counts as a space; tabs and line ends are none.
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def plain_title(html: Column) -> Column:
    """Text of the first bare <title>, without outer spaces; of its references only &amp; is decoded."""
    written = F.replace(F.regexp_extract(html, r"(?s)<title>(.*?)</title", 1), F.lit("&amp;"), F.lit("&"))
    return F.nullif(F.btrim(written, F.lit(_SPACES)), F.lit(""))


def plain_lang(html: Column) -> Column:
    """Language of an <html> that has it as its first attribute, in double quotes."""
    return F.nullif(F.regexp_extract(html, '<html lang="([a-zA-Z-]+)"', 1), F.lit(""))


def script_marks(html: Column) -> Column:
    """How often a script element is opened, in comments and other scripts too."""
    return F.size(F.regexp_extract_all(html, F.lit(r"(?iu)<script(?![0-9A-Za-z_])"), F.lit(0)))

"""Maps from keys to sets, JSON and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def values(m: Column) -> Column:
    """The union of all sets."""
    return F.array_sort(F.array_distinct(F.flatten(F.map_values(m))))


def entries(m: Column) -> Column:
    return F.map_entries(m)


def get(m: Column, key: Column) -> Column:
    """The set of a key, empty if it has none."""
    return F.coalesce(F.try_element_at(m, key), F.filter(F.get(F.map_values(m), 0), lambda x: F.lit(False)))


def pair_count(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0), lambda n, s: n + F.size(s))


def add(m: Column, key: Column, members: Column) -> Column:
    """A map with members added to a key's set."""
    old = F.try_element_at(m, key)
    new = F.array_sort(F.array_distinct(F.when(old.isNull(), members).otherwise(F.array_union(old, members))))
    return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, new))


def drop(m: Column, key: Column, members: Column | None = None) -> Column:
    """A map without members of a key's set, or without the key; a key whose set is empty is gone."""
    if members is None:
        return F.map_filter(m, lambda k, v: k != key)
    less = F.transform_values(m, lambda k, v: F.when(k == key, F.array_except(v, members)).otherwise(v))
    return F.map_filter(less, lambda k, v: F.size(v) > 0)


def store(m: Column, key: Column, members: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, F.array_sort(F.array_distinct(members))))


def map_table(ks: Column, fn) -> Column:
    """A map from each key to fn(key)."""
    return F.map_from_arrays(ks, F.transform(ks, fn))


def merge(a: Column, b: Column) -> Column:
    """Two maps of sets; the sets of a key are united."""
    return F.map_zip_with(a, b, lambda k, x, y: F.array_sort(F.array_distinct(F.concat(F.coalesce(x, F.filter(y, lambda _: F.lit(False))), F.coalesce(y, F.filter(x, lambda _: F.lit(False)))))))


# JSON


def json_field(s: Column, path: str, kind: str = "string") -> Column:
    return F.get_json_object(s, f"$.{path}").cast(kind)


def json_parse(s: Column, schema: str) -> Column:
    return F.from_json(s, schema)


def json_text(x: Column) -> Column:
    return F.to_json(x)


# addresses


def uri_scheme(u: Column) -> Column:
    return F.nullif(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit(""))


def uri_host(u: Column) -> Column:
    return F.nullif(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def uri_path(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?/?([^?#]*)", 1)


def uri_query(u: Column) -> Column:
    return F.nullif(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def uri_fragment(u: Column) -> Column:
    return F.nullif(F.regexp_extract(u, r"#(.*)$", 1), F.lit(""))


def uri_base(u: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_extract(u, r"^([^?#]*)", 1)


def uri_encode(s: Column) -> Column:
    return F.replace(F.call_function("url_encode", s), F.lit("+"), F.lit("%20"))


def uri_decode(s: Column) -> Column:
    return F.call_function("try_url_decode", s)


def merge_uris(uri: Column, base: Column) -> Column:
    """An address as it stands, or one relative to a base: below its folder, or from its root if it begins with a slash."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_extract(base, r"^([^?#]*)", 1), r"^(.*/)", 1)
    return F.when(uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), uri).when(uri.startswith("/"), F.concat(root, uri)).otherwise(F.concat(folder, uri))


def script_url(base: Column, *pairs: tuple[str, Column]) -> Column:
    """An address with a query of names and values."""
    parts = [F.concat(F.lit(k + "="), uri_encode(v.cast("string"))) for k, v in pairs]
    return F.concat(base, F.when(F.instr(base, "?") > 0, "&").otherwise("?"), F.concat_ws("&", *parts))


def data_uri(data: Column, kind: str = "text/plain") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(data.cast("binary")))

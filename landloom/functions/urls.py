"""Addresses, resource keys and file names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _form_decoded(text: Column) -> Column:
    """A form value as text: plus signs are spaces, percent signs that start no escape stay."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encoded(text: Column) -> Column:
    """Text as a form value: letters, digits and _.-~ stay, spaces become plus signs, all else is escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def form_pairs(query: Column) -> Column:
    """array of struct(k, i, v): names and values of a query's parameters, decoded, in order; a name alone has an empty value."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.substr(p, F.length(name(p)) + 2)
    return F.transform(pieces, lambda p, i: F.struct(_form_decoded(name(p)).alias("k"), i.alias("i"), _form_decoded(value(p)).alias("v")))


def canonicalize_url(url: Column, strip_params: tuple[str, ...] = (), keep_params: tuple[str, ...] = (), strip_query: bool = False) -> Column:
    """Lower-case scheme (https if there is none) and host, default port and fragment gone, parameters decoded, the last of
    equal names kept, sorted by name and encoded again. An address can lack its scheme, its host or both; tabs and line
    ends inside it go, and an empty parameter part (;) at its path's end does too."""
    clean = F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")
    part = lambda n: F.regexp_extract(clean, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?", n)
    scheme = F.coalesce(F.nullif(F.lower(part(1)), F.lit("")), F.lit("https"))
    host, path = F.lower(part(3)), F.regexp_replace(part(4), "(^|/)([^/;]*);$", "$1$2")
    port = F.when(scheme == "http", ":80").when(scheme == "https", ":443")
    host = F.when(host.endswith(port), F.substr(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)
    ordered = F.array_sort(F.transform(form_pairs(part(5)), lambda p: F.struct(p["k"].alias("k"), (-p["i"]).alias("i"), p["v"].alias("v"))))  # by name, the last of equal names first
    pairs = F.filter(ordered, lambda p, i: (i == 0) | (F.get(ordered, i - 1)["k"] != p["k"]))
    if strip_params:
        pairs = F.filter(pairs, lambda p: ~p["k"].isin(*strip_params))
    if keep_params:
        pairs = F.filter(pairs, lambda p: p["k"].isin(*keep_params))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))), "&")
    text = F.lit("") if strip_query else text
    rooted = F.when((host != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    before = F.when((host != "") | (path == "") | path.startswith("/"), F.concat(F.lit("//"), host)).otherwise("")
    return F.concat(scheme, F.lit(":"), before, rooted, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def resource_key(identity: Column, canonical_url: Column) -> Column:
    """id: and the given identity, at most 128 characters in all, else u: and the address's digest."""
    return F.when(F.coalesce(identity, F.lit("")) != "", F.substring(F.concat(F.lit("id:"), identity), 1, 128)).otherwise(F.concat(F.lit("u:"), F.substring(F.sha2(canonical_url, 256), 1, 48)))


def sanitize_filename(name: Column) -> Column:
    """Only letters, digits, dot, dash and underscore, none of them a leading dot, at most 128."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^A-Za-z0-9._-]+", "_")
    clean = F.substring(F.regexp_replace(base, r"^\.+", ""), 1, 128)
    return F.when(clean == "", "file").otherwise(clean)


def filename_of(disposition: Column, url: Column) -> Column:
    """From a Content-Disposition header, else the last path segment of the address, percent-decoded."""
    header = F.regexp_extract(F.coalesce(disposition, F.lit("")), r"filename\*?=(?:UTF-8'')?\"?([^\";]+)", 1)
    segment = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)
    return sanitize_filename(F.when(header != "", header).otherwise(F.try_url_decode(segment)))


def url_join(base: Column, href: Column) -> Column:
    """A link seen on a page as an absolute address."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(.*/)[^/]*$", 1)
    plain = F.regexp_replace(base, r"#.*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(plain, href)).when(href.startswith("?"), F.concat(F.regexp_replace(plain, r"\?.*$", ""), href)).when(href == "", plain).otherwise(F.concat(folder, href))
    )


def passes(value: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Matches any include pattern (if there are any) and no exclude pattern."""
    ok = F.lit(True)
    if include:
        ok = F.lit(False)
        for p in include:
            ok = ok | value.rlike(p)
    for p in exclude:
        ok = ok & ~value.rlike(p)
    return F.coalesce(ok, F.lit(False))

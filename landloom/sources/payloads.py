"""Fetched payloads to candidate tables: (source_key, url, filename, identity, metadata).

Each parser takes a DataFrame payloads(source_key, url, body) and is registered by source type. XML is read by XPath
without namespaces, HTML by patterns, JSON by typed schemas; nothing is fetched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import filename_of, passes, url_join

PARSERS: dict[str, Callable[..., DataFrame]] = {}


def parser(source_type: str):
    def add(run):
        PARSERS[source_type] = run
        return run

    return add


def candidates(df: DataFrame, url: Column, identity: Column, metadata: Column) -> DataFrame:
    return df.select("source_key", url.alias("url"), filename_of(F.lit(None).cast("string"), url).alias("filename"), identity.alias("identity"), metadata.alias("metadata"))


def meta(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


_LINK = r"(?is)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)[^>]*>(.*?)</a>"
_XMLNS = r"\sxmlns(:\w+)?=\"[^\"]*\""


def _character(piece: Column) -> Column:
    """What an entity (numeric, or one of XML's five) stands for; any other piece as it is."""
    digits = F.regexp_extract(piece, "^&#[xX]?([0-9A-Fa-f]{1,7});$", 1)
    code = F.when(piece.rlike("^&#[xX]"), F.lpad(digits, 8, "0")).otherwise(F.lpad(F.hex(digits.try_cast("int")), 8, "0"))
    named = F.when(piece == "&lt;", "<").when(piece == "&gt;", ">").when(piece == "&quot;", '"').when(piece == "&apos;", "'").when(piece == "&amp;", "&").otherwise(piece)
    return F.when(digits == "", named).otherwise(F.coalesce(F.decode(F.unhex(code), "UTF-32"), piece))


def _unescaped(text: Column) -> Column:
    """Entities resolved, each once."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(&#?[0-9A-Za-z]+;|[^&]+|&)"), 1), _character), "")


def links(pages: DataFrame) -> DataFrame:
    """pages(source_key, url, page, body) -> ord, href, title of every anchor, in page and reading order."""
    hrefs, titles = F.regexp_extract_all("body", F.lit(_LINK), F.lit(1)), F.regexp_extract_all("body", F.lit(_LINK), F.lit(2))
    e = pages.select("source_key", "url", "page", F.posexplode(F.arrays_zip(hrefs.alias("href"), titles.alias("title"))).alias("ord", "a"))
    return e.select("source_key", "page", "ord", url_join(F.col("url"), _unescaped(F.trim(F.regexp_replace("a.href", r"^[\"']|[\"']$", "")))).alias("link"), F.trim(F.regexp_replace(F.regexp_replace("a.title", "<[^>]*>", " "), r"\s+", " ")).alias("title"))


@parser("html")
def html_index(pages: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), title: tuple[str, ...] = (), max_resources: int | None = None) -> DataFrame:
    """Links of index pages, filtered, first of equal addresses; pages from the first one without links on are ignored."""
    found = links(pages)
    counts = pages.select("source_key", "page").join(found.groupBy("source_key", "page").agg(F.count(F.lit(1)).alias("n")), ["source_key", "page"], "left")
    stop = counts.where("n IS NULL").groupBy("source_key").agg(F.min("page").alias("stop"))
    kept = found.join(stop, "source_key", "left").where("stop IS NULL OR page < stop").where(passes(F.col("link"), include, exclude) & passes(F.col("title"), title))
    one = first_by(kept, ["source_key", "link"], ["page", "ord"])
    if max_resources is not None:
        w = Window.partitionBy("source_key").orderBy("page", "ord")
        one = one.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_resources)
    return candidates(one, F.col("link"), F.lit(None).cast("string"), meta(title=F.col("title")))


def attachments(listing: DataFrame, details: DataFrame, formats: tuple[str, ...] = ("pdf", "zip")) -> DataFrame:
    """listing(source_key, url, title) joined to the detail pages it names; their attachment links, titles carried."""
    pages = listing.select("source_key", "url", F.col("title").alias("carried")).join(details, ["source_key", "url"])
    found = links(pages.withColumn("page", F.lit(1))).join(pages.select("source_key", "url", "carried"), "source_key")
    wanted = found.where(F.lower("link").rlike(r"\.(" + "|".join(formats) + r")([?#].*)?$"))
    return candidates(first_by(wanted, ["source_key", "link"], ["ord"]), F.col("link"), F.lit(None).cast("string"), meta(title=F.coalesce("carried", "title")))




def xml_elements(df: DataFrame, name: str) -> DataFrame:
    """df(body) with one row for each element of that local name: ord, item (its text, prefixes gone)."""
    plain = F.regexp_replace(F.regexp_replace("body", _XMLNS, ""), r"(</?)\w+:", "$1")
    pattern = rf"(?s)<{name}(?:\s[^>]*)?>.*?</{name}>"
    return df.select("*", F.posexplode(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))).alias("ord", "item"))


def child(item: Column, path: str) -> Column:
    """Text of an element's child or attribute; null when absent or when the element isn't well-formed."""
    safe = F.when(item.isNotNull(), F.regexp_replace(item, r"&(?!(amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", "&amp;"))
    return F.nullif(F.trim(F.xpath_string(safe, F.lit(path))), F.lit(""))


@parser("sitemap")
def sitemap(payloads: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), cap: int | None = None, budget: int = 50) -> DataFrame:
    """Addresses of url sets, reached through index files among the payloads; each file is read once, `budget` levels."""
    roots = payloads.where(F.coalesce(F.col("root"), F.lit(True))) if "root" in payloads.columns else payloads
    frontier, seen, sets = roots.select("source_key", "url", "body"), None, None
    for _ in range(budget):
        found = xml_elements(frontier, "url")
        sets = found if sets is None else sets.union(found)
        seen = frontier.select("source_key", "url") if seen is None else seen.union(frontier.select("source_key", "url"))
        more = xml_elements(frontier, "sitemap").select("source_key", child(F.col("item"), "/sitemap/loc").alias("url")).distinct().join(seen, ["source_key", "url"], "left_anti")
        frontier = more.join(payloads.select("source_key", "url", "body"), ["source_key", "url"])
        if frontier.isEmpty():
            break
    rows = sets.select("source_key", F.col("url").alias("file"), "ord", child(F.col("item"), "/url/loc").alias("loc"), child(F.col("item"), "/url/lastmod").alias("lastmod")).where("loc IS NOT NULL")
    one = first_by(rows.where(passes(F.col("loc"), include, exclude)), ["source_key", "loc"], ["file", "ord"])
    if cap is not None:
        one = one.withColumn("_n", F.row_number().over(Window.partitionBy("source_key").orderBy("file", "ord"))).where(F.col("_n") <= cap)
    return candidates(one, F.col("loc"), F.lit(None).cast("string"), meta(lastmod=F.col("lastmod")))


@parser("feed")
def feed(payloads: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """RSS items and Atom entries: the first enclosure that passes, else the page's link; identity is the guid or id."""
    rss = xml_elements(payloads, "item").select("source_key", "ord", F.xpath(F.col("item"), F.lit("/item/enclosure/@url")).alias("files"), child(F.col("item"), "/item/link").alias("link"), child(F.col("item"), "/item/guid").alias("guid"), child(F.col("item"), "/item/title").alias("title"))
    atom = xml_elements(payloads, "entry").select("source_key", "ord", F.xpath(F.col("item"), F.lit("/entry/link[@rel='enclosure']/@href")).alias("files"), child(F.col("item"), "/entry/link[not(@rel) or @rel='alternate']/@href").alias("link"), child(F.col("item"), "/entry/id").alias("guid"), child(F.col("item"), "/entry/title").alias("title"))
    rows = rss.unionByName(atom)
    pick = F.coalesce(F.get(F.filter("files", lambda u: passes(u, include)), F.lit(0)), F.when(passes(F.col("link"), include), F.col("link")))
    rows = rows.withColumn("pick", pick).where("pick IS NOT NULL").withColumn("identity", F.coalesce("guid", "pick"))
    return candidates(first_by(rows, ["source_key", "identity"], ["ord"]), F.col("pick"), F.col("identity"), meta(title=F.col("title")))


@parser("ckan")
def ckan(payloads: DataFrame, formats: tuple[str, ...] = ()) -> DataFrame:
    """Resources of a package search's answer, of the wanted formats, first of equal resource ids."""
    schema = "result struct<results:array<struct<id:string,title:string,resources:array<struct<id:string,url:string,format:string,name:string>>>>>"
    p = payloads.select("source_key", F.posexplode(F.from_json("body", schema)["result"]["results"]).alias("po", "p"))
    r = p.select("source_key", "po", F.col("p.title").alias("package"), F.posexplode("p.resources").alias("ro", "r")).where("r.url IS NOT NULL AND r.url <> ''")
    if formats:
        r = r.where(F.lower("r.format").isin(*formats))
    one = first_by(r.withColumn("rid", F.coalesce("r.id", "r.url")), ["source_key", "rid"], ["po", "ro"])
    return candidates(one, F.col("r.url"), F.concat(F.lit("ckan:"), F.col("rid")), meta(title=F.coalesce("r.name", "package"), format=F.lower("r.format")))


@parser("ogc_api")
def ogc_collections(payloads: DataFrame, allow: tuple[str, ...] = (), cap: int | None = None) -> DataFrame:
    c = payloads.select("source_key", "url", F.posexplode(F.from_json("body", "collections array<struct<id:string,title:string>>")["collections"]).alias("ord", "c")).where("c.id IS NOT NULL")
    if allow:
        c = c.where(F.col("c.id").isin(*allow))
    if cap is not None:
        c = c.withColumn("_n", F.row_number().over(Window.partitionBy("source_key").orderBy("ord"))).where(F.col("_n") <= cap)
    url = F.concat(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", ""), F.lit("/"), F.col("c.id"), F.lit("/items"))
    return candidates(c, url, F.concat(F.lit("ogc:"), F.col("c.id")), meta(title=F.col("c.title")))


def ogc_items(pages: DataFrame, max_features: int) -> tuple[DataFrame, DataFrame]:
    """pages(source_key, page, body) -> features up to the limit in page order, and (source_key, total, truncated)."""
    f = pages.select("source_key", "page", F.posexplode(F.from_json("body", "features array<string>")["features"]).alias("ord", "feature"))
    total = f.groupBy("source_key").agg(F.count(F.lit(1)).alias("total")).withColumn("truncated", F.col("total") > max_features)
    w = Window.partitionBy("source_key").orderBy("page", "ord")
    return f.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_features), total


@parser("wfs")
def wfs_types(payloads: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    t = xml_elements(payloads, "FeatureType").select("source_key", "url", "ord", *[child(F.col("item"), f"/FeatureType/{n}").alias(n.lower()) for n in ("Name", "Title", "DefaultCRS", "DefaultSRS")])
    t = t.where(passes(F.col("name"), include, exclude))
    url = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?service=WFS&request=GetFeature&typeNames="), F.col("name"))
    return candidates(t, url, F.concat(F.lit("wfs:"), F.col("name")), meta(title=F.col("title"), crs=F.coalesce("defaultcrs", "defaultsrs")))


@parser("wms")
def wms_layers(payloads: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Layers with a name; a group without one is no candidate."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", r"(?s)<!--.*?-->", ""), _XMLNS, ""), r"(</?)\w+:", "$1")
    own = F.regexp_replace(plain, r"(?s)<(Style|MetadataURL|Attribution|Identifier)\b[^>]*?(?:/>|>.*?</\1>)", "")  # these have names of their own
    # a layer's own part ends where the next layer starts or a layer ends, so groups and their members are told apart
    t = payloads.select("source_key", "url", F.posexplode(F.regexp_extract_all(own, F.lit(r"(?s)<Layer\b[^>]*>(.*?)(?=<Layer\b|</Layer>)"), F.lit(1))).alias("ord", "item"))
    text = lambda tag: F.nullif(_unescaped(F.trim(F.regexp_extract("item", rf"(?s)<{tag}>([^<]*)</{tag}>", 1))), F.lit(""))
    t = t.select("source_key", "url", "ord", text("Name").alias("name"), text("Title").alias("title"))
    return candidates(t.where(F.col("name").isNotNull() & passes(F.col("name"), include, exclude)), F.col("url"), F.concat(F.lit("wms:"), F.col("name")), meta(title=F.coalesce("title", "name")))


@parser("arcgis")
def arcgis_layers(payloads: DataFrame) -> DataFrame:
    """One candidate for each layer answer: its object id field, whether it pages, and its largest page."""
    schema = "id int, name string, type string, maxRecordCount int, objectIdField string, advancedQueryCapabilities struct<supportsPagination:boolean>, fields array<struct<name:string,type:string>>"
    p = payloads.select("source_key", "url", F.from_json("body", schema).alias("l")).where("l.id IS NOT NULL AND coalesce(l.type, 'Feature Layer') = 'Feature Layer'")
    oid = F.coalesce("l.objectIdField", F.get(F.filter("l.fields", lambda f: f["type"] == "esriFieldTypeOID"), F.lit(0))["name"], F.lit("OBJECTID"))
    url = F.concat(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", ""), F.lit("/query"))
    return candidates(p, url, F.concat(F.lit("arcgis:"), F.col("l.id").cast("string")), meta(title=F.col("l.name"), oid=oid, pages=F.coalesce("l.advancedQueryCapabilities.supportsPagination", F.lit(False)), max_records=F.coalesce("l.maxRecordCount", F.lit(1000))))


def arcgis_harvest(batches: DataFrame, expected: DataFrame) -> DataFrame:
    """batches(layer, body) of query answers, expected(layer, server_count) -> layer, harvested, server_count, complete."""
    f = batches.select("layer", F.explode(F.from_json("body", "features array<string>")["features"]).alias("f"))
    got = f.groupBy("layer").agg(F.count(F.lit(1)).alias("harvested"))
    return expected.join(got, "layer", "left").select("layer", F.coalesce("harvested", F.lit(0)).alias("harvested"), "server_count", (F.coalesce("harvested", F.lit(0)) == F.col("server_count")).alias("complete"))


#: Portal fields and what they are called here.
PORTAL_FIELDS = {"tenDoAn": "title", "soQuyetDinh": "decision_number", "ngayBanHanh": "signed_date", "coQuanPheDuyet": "approving_authority", "maQuyHoach": "planning_code", "tyLe": "scale", "dienTich": "area"}


def portal_hints(record: Column) -> Column:
    """A portal's record under our names: empty words dropped, dd/mm/yyyy made ISO."""
    names = F.create_map(*[F.lit(x) for p in PORTAL_FIELDS.items() for x in p])
    known = F.map_filter(record, lambda k, v: names[k].isNotNull() & v.isNotNull() & ~F.lower(F.trim(v)).isin("none", "null", ""))
    renamed = F.transform_keys(known, lambda k, _: names[k])
    iso = lambda v: F.regexp_replace(v, r"^\s*(\d{2})/(\d{2})/(\d{4}).*$", "$3-$2-$1")
    return F.transform_values(renamed, lambda k, v: F.when(k == "signed_date", iso(v)).otherwise(F.trim(v)))

"""Queries on text, addresses, dates and properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, properties, text, urls
from .base import query, relation, table

_NORM = "lower(trim(regexp_replace(strip_accents(translate({x}, 'đĐ', 'dD')), '\\s+', ' ', 'g')))"


@query("vn_normalize", f"SELECT doc_id, {_NORM.format(x='text')} AS folded FROM documents")
def vn_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.vn_normalize(F.col("text")).alias("folded"))


@query("fold_token", f"SELECT p_partkey, {_NORM.format(x='p_name')} || ' dat o 12 dat' AS token FROM part")
def fold_token(spark, sf):
    """Names in full-width letters, with marks apart and composed, full-width digits and the barred d."""
    low = "abcdefghijklmnopqrstuvwxyz"
    wide = F.translate(F.col("p_name"), low, "".join(chr(ord(c) + 0xFEE0) for c in low))
    return table(spark, sf, "part").select("p_partkey", text.fold_token(F.concat(wide, F.lit(" \u0110a\u0302\u0301t \u1edf \uff11\uff12 \u0111\u1ea5t"))).alias("token"))


@query("parse_coordinates", "SELECT point_id, lon, lat FROM (SELECT point_id, CAST(round(lon, 4) AS DOUBLE) AS lon, CAST(round(lat, 4) AS DOUBLE) AS lat FROM points)")
def parse_coordinates(spark, sf):
    p = relation(spark, sf, "points").select("point_id", F.format_string("%.4f", F.round("lon", 4)).alias("x"), F.format_string("%.4f", F.round("lat", 4)).alias("y"))
    q = F.when(F.col("point_id") % 4 == 0, F.concat_ws(", ", "x", "y")).when(F.col("point_id") % 4 == 1, F.concat_ws(" ", "y", "x"))
    q = q.when(F.col("point_id") % 4 == 2, F.concat(F.lit("https://m.example/#map=10/"), F.col("y"), F.lit("/"), F.col("x"))).otherwise(F.concat(F.lit("https://m.example/?lat="), F.col("y"), F.lit("&lng="), F.col("x")))
    return p.select("point_id", text.parse_coordinates(q).alias("c")).select("point_id", "c.lon", "c.lat")


#: Every address, and in turn: form values to decode, blank and repeated names, a default port, no scheme, no host.
_URLS = """u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat(split_part(url, '#', 1), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'q=a+c%20d&b=%C3%A9*~&b&q=', page_id)
  WHEN 1 THEN replace(url, '.example.', '.EXAMPLE.') WHEN 2 THEN regexp_replace(split_part(url, '#', 1), '^(https?)://([^/]*)', concat('HTTPS://', '\\2', ':443')) WHEN 3 THEN regexp_replace(url, '^https?:', '')
  WHEN 4 THEN concat(url, ';') ELSE url END AS url FROM pages)"""
_CANON = f"""{_URLS}, w AS (SELECT page_id, coalesce(nullif(lower(regexp_extract(url, '^([A-Za-z]+):', 1)), ''), 'https') AS scheme, lower(regexp_extract(url, '^(?:[A-Za-z]+:)?//([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^(?:[A-Za-z]+:)?//[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM u),
one AS (SELECT page_id, unnest(list_filter(string_split(query, '&'), lambda x: x <> '')) AS p, generate_subscripts(list_filter(string_split(query, '&'), lambda x: x <> ''), 1) AS i FROM w),
kv AS (SELECT page_id, i, url_decode(replace(split_part(p, '=', 1), '+', ' ')) AS k, url_decode(replace(CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END, '+', ' ')) AS v FROM one),
last AS (SELECT page_id, k, arg_max(v, i) AS v FROM kv GROUP BY 1, 2),
joined AS (SELECT page_id, string_agg(replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+'), '&' ORDER BY k) AS query FROM last GROUP BY 1),
c AS (SELECT w.page_id, scheme || '://' || CASE WHEN scheme = 'https' AND ends_with(host, ':443') THEN left(host, -4) ELSE host END || CASE WHEN ends_with(path, ';') AND NOT contains(regexp_extract(path, '([^/]*)$', 1)[:-2], ';') THEN left(path, -1) ELSE path END
  || coalesce('?' || joined.query, '') AS canonical FROM w LEFT JOIN joined ON w.page_id = joined.page_id)"""


def _addresses(spark, sf):
    return spark.sql(f"WITH {_URLS.replace(chr(92) + '2', '$2').replace('FROM pages', 'FROM {pages}')} SELECT page_id, url FROM u", pages=table(spark, sf, "pages"))


@query("canonical_url", f"WITH {_CANON} SELECT page_id, canonical FROM c")
def canonical_url(spark, sf):
    return _addresses(spark, sf).select("page_id", urls.canonicalize_url(F.col("url")).alias("canonical"))


@query("resource_key", f"WITH {_CANON} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'id:p' || page_id ELSE 'u:' || substr(sha256(canonical), 1, 48) END AS resource_key FROM c")
def resource_key(spark, sf):
    identity = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("p"), F.col("page_id").cast("string")))
    return _addresses(spark, sf).select("page_id", urls.resource_key(identity, urls.canonicalize_url(F.col("url"))).alias("resource_key"))


@query("filename", "SELECT page_id, CASE WHEN f = '' THEN 'file' ELSE f END AS filename FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS f FROM pages)")
def filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.filename_of(F.lit(None).cast("string"), F.col("url")).alias("filename"))


_PARTS = """SELECT 'record' AS kind, CAST(p_partkey AS BIGINT) AS id, lower(p_name) AS title, 1 AS place FROM part UNION ALL SELECT 'unit', CAST(n_nationkey AS BIGINT), lower(n_name), 2 FROM nation UNION ALL SELECT 'supplier', s_suppkey, lower(s_name), 3 FROM supplier"""


@query("search", f"""WITH e AS ({_PARTS}), q(q) AS (SELECT DISTINCT lower(substr(n_name, 1, 3)) FROM nation),
m AS (SELECT q, kind, id, title, place, row_number() OVER (PARTITION BY q, kind ORDER BY length(title), id) AS in_kind FROM q JOIN e ON contains(title, q)),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place, in_kind) AS rank FROM m WHERE in_kind <= 10)
SELECT q, kind, id, title, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def search(spark, sf):
    from ..operators.search import search as run

    records = table(spark, sf, "part").select(F.lit("record").alias("kind"), F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("title"), F.lit(1).alias("place"))
    units = table(spark, sf, "nation").select(F.lit("unit"), F.col("n_nationkey").cast("bigint"), "n_name", F.lit(2))
    suppliers = table(spark, sf, "supplier").select(F.lit("supplier"), "s_suppkey", "s_name", F.lit(3))
    asked = table(spark, sf, "nation").select(F.lower(F.substring("n_name", 1, 3)).alias("q")).distinct()
    return run(asked, records.union(units).union(suppliers), limit=10).select("q", "kind", "id", text.vn_normalize(F.col("title")).alias("title"), "rank")


def _page_text(spark, sf):
    """Documents with a planning masthead put before their text, by number."""
    k = F.col("doc_id")
    mast = F.concat(F.lit("Quyết định số "), (k % 900 + 1).cast("string"), F.lit("/QD-UBND ngày "), (k % 28 + 1).cast("string"), F.lit(" tháng "), (k % 12 + 1).cast("string"), F.lit(" năm "), (k % 20 + 2000).cast("string"), F.lit("; tỷ lệ 1/"), ((k % 5 + 1) * 1000).cast("string"), F.lit(". "))
    return table(spark, sf, "documents").select("doc_id", (k % 3 + 1).alias("page"), F.when(k % 2 == 0, F.concat(mast, F.col("text"))).otherwise(F.col("text")).alias("text"))


_DAY = ("doc_id % 28 + 1", "doc_id % 12 + 1", "doc_id % 20 + 2000")
#: name -> what its pattern meets in the masthead, as SQL over doc_id, and the value it gives
_MET = {
    "decision_number": ("'quyet dinh so ' || (doc_id % 900 + 1) || '/qd-ubnd'", "(doc_id % 900 + 1) || '/QD-UBND'"),
    "signed_date": ("printf('ngay %d thang %d nam %d', {}, {}, {})".format(*_DAY), "printf('%04d-%02d-%02d', {2}, {1}, {0})".format(*_DAY)),
    "scale": ("'ty le 1/' || ((doc_id % 5 + 1) * 1000)", "'1/' || ((doc_id % 5 + 1) * 1000)"),
    "planning_code": ("'ma quy hoach: qh-' || doc_id", "'QH-' || doc_id"),
    "supersedes_decision": ("'thay the quyet dinh so ' || (doc_id % 70 + 1) || '/qd-cp'", "(doc_id % 70 + 1) || '/QD-CP'"),
    "planning_period": ("'thoi ky 2021 - ' || (doc_id % 20 + 2030)", "'2021-' || (doc_id % 20 + 2030)"),
    "effective_date": ("printf('co hieu luc tu ngay %d/%d/%d', {}, {}, {})".format(*_DAY), "printf('%04d-%02d-%02d', {2}, {1}, {0})".format(*_DAY)),
    "effective_from_signed": ("'co hieu luc ke tu ngay ky'", "'signed_date'"),
    "plan_title": ("'quy hoach chung khu ' || doc_id", "'quy hoach chung khu ' || doc_id"),
    "approving_authority": ("'uy ban nhan dan tinh ninh binh'", "'uy ban nhan dan tinh ninh binh'"),
}
_WHOLE = "concat_ws('', " + ", ', ', ".join(_MET[n][0] for n in list(_MET)[:8]) + ", '. ', " + _MET["plan_title"][0] + ", '. ', " + _MET["approving_authority"][0] + ", '. ', text)"


@query("text_candidates", f"WITH p AS (SELECT doc_id, {_NORM.format(x=_WHOLE)} AS folded FROM documents WHERE doc_id % 2 = 0), m AS (" + " UNION ALL ".join(f"SELECT doc_id, folded, '{n}' AS name, {met} AS met, {value} AS value FROM p" for n, (met, value) in _MET.items()) + """),
  a AS (SELECT *, instr(folded, met) AS pos, greatest(instr(folded, met) - 20, 1) AS first FROM m)
SELECT doc_id, name, value, doc_id % 3 + 1 AS page, substr(trim(substr(folded, first, pos + length(met) + 90 - first)), 1, 160) AS snippet FROM a""")
def text_candidates(spark, sf):
    """All patterns, in whole texts that start with a masthead where the number is even."""
    k = F.col("doc_id")
    d, m, y = (x.cast("string") for x in (k % 28 + 1, k % 12 + 1, k % 20 + 2000))
    t = lambda x: x.cast("string")
    head = F.concat(
        F.lit("Quyết định số "), t(k % 900 + 1), F.lit("/QD-UBND, ngày "), d, F.lit(" tháng "), m, F.lit(" năm "), y, F.lit(", tỷ lệ 1/"), t((k % 5 + 1) * 1000), F.lit(", Mã quy hoạch: QH-"), t(k),
        F.lit(", thay thế quyết định số "), t(k % 70 + 1), F.lit("/QD-CP, thời kỳ 2021 - "), t(k % 20 + 2030), F.lit(", có hiệu lực từ ngày "), d, F.lit("/"), m, F.lit("/"), y,
        F.lit(", có hiệu lực kể từ ngày ký. Quy hoạch chung khu "), t(k), F.lit(". Ủy ban nhân dân tỉnh Ninh Bình. "),
    )
    pages = table(spark, sf, "documents").select("doc_id", (k % 3 + 1).alias("page"), F.when(k % 2 == 0, F.concat(head, F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))
    return text.text_candidates(pages).select("doc_id", "name", "value", "page", "snippet")


@query("document_metadata", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'N' || doc_id WHEN doc_id % 2 = 0 THEN (doc_id % 900 + 1) || '/QD-UBND' END AS document_number,
  CASE WHEN doc_id % 5 = 0 THEN 'explicit' WHEN doc_id % 2 = 0 THEN 'machine' END AS number_origin,
  CASE WHEN doc_id % 2 = 0 THEN make_date(doc_id % 20 + 2000, doc_id % 12 + 1, doc_id % 28 + 1) END AS signed_date,
  CASE WHEN doc_id % 2 = 0 THEN 'machine' WHEN doc_id % 5 = 0 THEN 'explicit' ELSE 'unknown' END AS origin, CASE WHEN doc_id % 2 = 0 THEN 60 ELSE 55 END AS task_priority FROM documents""")
def document_metadata(spark, sf):
    from ..operators.documents import build_metadata

    known = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("N"), F.col("doc_id").cast("string"))).alias("document_number"), F.lit(None).cast("string").alias("signed_date"))
    return build_metadata(known, text.text_candidates(_page_text(spark, sf)))


@query("fill_empty", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'kept' WHEN doc_id % 2 = 0 THEN (doc_id % 900 + 1) || '/QD-UBND' END AS document_number, doc_id % 2 = 0 AND doc_id % 7 <> 0 AS filled, doc_id % 3 <> 0 AS new_task FROM documents""")
def fill_empty(spark, sf):
    from ..operators.documents import ensure_tasks, fill_only_empty

    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("kept")).alias("document_number"))
    found = text.text_candidates(_page_text(spark, sf)).where("name = 'decision_number'").select("doc_id", F.col("value").alias("document_number"))
    pending = docs.where("doc_id % 3 = 0").select(F.lit("document").alias("target_type"), F.col("doc_id").alias("target_id"))
    filled = fill_only_empty(docs, found, "doc_id", "document_number")
    tasks = ensure_tasks(docs.select(F.lit("document").alias("target_type"), F.col("doc_id").alias("target_id")), pending)
    return filled.join(tasks.select(F.col("target_id").alias("doc_id"), F.lit(True).alias("t")), "doc_id", "left").select("doc_id", "document_number", "filled", F.coalesce("t", F.lit(False)).alias("new_task"))


@query("extraction_stats", "SELECT source, count(*) AS processed, count(*) FILTER (WHERE n_chars < 500) AS skipped, count(*) FILTER (WHERE doc_id % 2 = 0) AS with_candidates FROM documents GROUP BY source")
def extraction_stats(spark, sf):
    found = text.text_candidates(_page_text(spark, sf)).select("doc_id").distinct().withColumn("hit", F.lit(True))
    docs = table(spark, sf, "documents").join(found, "doc_id", "left")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("n_chars") < 500).alias("skipped"), F.count_if(F.col("hit") & (F.col("doc_id") % 2 == 0)).alias("with_candidates"))


@query("origin_weakest", "SELECT source, CASE max(CASE quality WHEN 1 THEN 1 ELSE 2 END + 2 * toxic) WHEN 1 THEN 'explicit' WHEN 2 THEN 'deterministic' WHEN 3 THEN 'unknown' ELSE 'machine' END AS origin FROM labels JOIN documents USING (doc_id) GROUP BY source")
def origin_weakest(spark, sf):
    from ..operators.documents import weakest_origin

    rank = F.when(F.col("quality") == 1, 1).otherwise(2) + 2 * F.col("toxic")
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("source", F.element_at(F.array(*map(F.lit, ("explicit", "deterministic", "unknown", "machine"))), rank).alias("origin"))
    return weakest_origin(rows, "source", "origin")


@query("date_parse", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS slashed, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS strict FROM orders""")
def date_parse(spark, sf):
    d = F.col("o_orderdate")
    strict = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy-MM"))
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_date(F.date_format(d, "yyyy-MM-dd HH:mm")).alias("iso"), dates.vietnamese_date(F.date_format(d, "d/M/yyyy")).alias("slashed"), dates.strict_date(strict).alias("strict"))


def _properties(spark, sf):
    k = F.col("c_custkey")
    entries = [("c_name", F.col("c_name")), ("loai_dat", F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise("")), ("type", F.when(k % 2 == 0, F.lit("T"))), ("code", F.when(k % 4 == 0, F.concat(F.lit("C"), k.cast("string"))))]
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.map_filter(F.create_map(*[x for n, v in entries for x in (F.lit(n), v)]), lambda _, v: v.isNotNull()).alias("p"))


@query("property_map", "SELECT c_custkey, CAST(2 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n, c_name AS ten FROM customer")
def property_map(spark, sf):
    p = _properties(spark, sf).withColumn("p", properties.rename_properties(F.col("p"), {"c_name": "ten"}))
    return p.select("c_custkey", F.size("p").alias("n"), F.col("p")["ten"].alias("ten"))


@query("classification", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'T' END AS class FROM customer")
def classification(spark, sf):
    return _properties(spark, sf).select("c_custkey", properties.classification(F.col("p")).alias("class"))


@query("stable_key", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'C' || c_custkey ELSE 'L' || c_nationkey || '#' || c_custkey END AS fkey FROM customer")
def stable_key(spark, sf):
    return _properties(spark, sf).select("c_custkey", properties.stable_key(F.col("p"), F.concat(F.lit("L"), F.col("c_nationkey").cast("string")), F.col("c_custkey")).alias("fkey"))


@query("layer_match", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'by_name' WHEN n_nationkey % 4 = 1 THEN 'by_alias' WHEN n_nationkey % 4 = 2 THEN 'by_stem' END AS config FROM nation")
def layer_match(spark, sf):
    from ..operators.registry import match_layer_config

    n = table(spark, sf, "nation")
    layers = n.select("n_nationkey", F.col("n_name").alias("layer"), F.concat(F.lit("file"), F.col("n_nationkey").cast("string")).alias("stem"))
    k = F.col("n_nationkey")
    configs = n.where(k % 4 != 3).select(F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.concat(F.lit("alias"), k.cast("string"))).otherwise(F.concat(F.lit("file"), k.cast("string"))).alias("name"), F.when(k % 4 == 0, "by_name").when(k % 4 == 1, "by_alias").otherwise("by_stem").alias("config"))
    aliases = n.where(k % 4 == 1).select(F.col("n_name").alias("raw"), F.concat(F.lit("alias"), k.cast("string")).alias("alias"))
    return match_layer_config(layers, configs, aliases).select("n_nationkey", "config")


@query("group_name", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'quy_hoach' WHEN 1 THEN 'hien_trang' WHEN 2 THEN 'hoso_gis' WHEN 3 THEN 'moc_gioi' ELSE 'other' END AS grp FROM region")
def group_name(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Quy Hoach", "hien-trang", "", "boundary_markers", "HoSoScan")]), F.col("r_regionkey") + 1)
    return table(spark, sf, "region").select("r_regionkey", properties.group_name(raw).alias("grp"))


@query("json_safe", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS a, c_acctbal AS b FROM customer")
def json_safe(spark, sf):
    a = F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).when(F.col("c_custkey") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    m = properties.json_safe(F.create_map(F.lit("a"), a, F.lit("b"), F.col("c_acctbal")))
    return table(spark, sf, "customer").select("c_custkey", m["a"].alias("a"), m["b"].alias("b"))


@query("json_unwrap", "SELECT event_id, props AS inner_json, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_unwrap(spark, sf):
    twice = F.to_json(F.struct(F.to_json(F.struct(F.col("props").alias("v"))).alias("v")))
    once = F.regexp_extract(F.to_json(F.struct(F.col("props").alias("v"))), r'^\{"v":(.*)\}$', 1)
    e = table(spark, sf, "events").select("event_id", properties.unwrap_json(F.when(F.length(twice) > 0, once)).alias("inner_json"))
    return e.select("event_id", "inner_json", F.get_json_object("inner_json", "$.k").cast("bigint").alias("k"))


@query("json_predicate", "SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 GROUP BY event_type")
def json_predicate(spark, sf):
    return table(spark, sf, "events").where(F.get_json_object("props", "$.k").cast("int") % 2 == 0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("origin_merge", "SELECT c_custkey, 'a' AS x, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS y FROM customer")
def origin_merge(spark, sf):
    a = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("a"))).otherwise(F.create_map(F.lit("x"), F.lit("a")))
    m = properties.merge_first(a, F.create_map(F.lit("x"), F.lit("b"), F.lit("y"), F.lit("b")))
    return table(spark, sf, "customer").select("c_custkey", m["x"].alias("x"), m["y"].alias("y"))


@query("content_digest", """WITH h AS (SELECT source, sha256(concat_ws(chr(1), doc_id, lang, text)) AS h FROM documents),
b AS (SELECT source, CAST('0x' || substr(h, 1, 6) AS BIGINT) % 64 AS bucket, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM h GROUP BY ALL)
SELECT source, sha256(string_agg(digest, '' ORDER BY bucket)) AS digest FROM b GROUP BY source""")
def content_digest(spark, sf):
    from ..operators.dedupe import digests

    h = F.sha2(F.concat_ws("\x01", "doc_id", "lang", "text"), 256)
    return digests(table(spark, sf, "documents").select("source", h.alias("h")), ["source"], "h")


@query("search_geocoded", "SELECT o_orderkey % 30 AS q, CASE WHEN o_orderkey % 30 < 25 THEN n_name ELSE 'fallback' END AS title, count(*) AS n FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 30 GROUP BY ALL")
def search_geocoded(spark, sf):
    from ..operators.search import with_geocoder

    asked = table(spark, sf, "orders").select((F.col("o_orderkey") % 30).alias("q"))
    found = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("q"), F.col("n_name").alias("title"))
    gazetteer = asked.select("q").distinct().withColumn("title", F.lit("fallback"))
    return with_geocoder(asked, found, gazetteer).groupBy("q", "title").agg(F.count(F.lit(1)).alias("n"))



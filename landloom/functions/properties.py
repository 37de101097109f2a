"""Property maps, classifications, keys, groups and JSON hygiene as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a class and a key are looked for, in this order.
CLASS_FIELDS = ("classification", "land_use", "loai_dat", "ma_loai_dat", "ma_tuyen", "type")
KEY_FIELDS = ("OBJECTID", "objectid", "id", "ID", "code", "ma_doi_tuong", "MaDT")
#: The planning groups and the names that mean them.
GROUPS = {"nen_dia_hinh": ("nendiahinh", "nen_dia_hinh", "terrain"), "hien_trang": ("hientrang", "hien_trang", "existing"), "quy_hoach": ("quyhoach", "quy_hoach", "planning"), "moc_gioi": ("mocgioi", "moc_gioi", "boundary_markers"), "hoso_gis": ("hosogis",)}
#: Derivation levels, best first, and those that are official.
LEVELS = ("official_vector", "official_raster", "official_document", "derived_human_reviewed", "derived_machine_reviewed", "derived_machine_unreviewed", "reference_approximate")
OFFICIAL = LEVELS[:3]


def rename_properties(properties: Column, field_map: dict[str, str]) -> Column:
    if not field_map:
        return properties
    names = F.create_map(*[F.lit(x) for pair in field_map.items() for x in pair])
    return F.transform_keys(properties, lambda k, _: F.coalesce(names[k], k))


def first_truthy(properties: Column, fields: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.nullif(properties[f], F.lit("")), F.lit("0")) for f in fields])


def classification(properties: Column) -> Column:
    return first_truthy(properties, CLASS_FIELDS)


def stable_key(properties: Column, layer: Column, fid: Column, key_field: str | None = None) -> Column:
    fields = ((key_field,) if key_field else ()) + KEY_FIELDS
    return F.coalesce(*[F.nullif(properties[f], F.lit("")) for f in fields], F.concat(layer, F.lit("#"), fid.cast("string")))


def group_name(raw: Column) -> Column:
    low = F.replace(F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit("")), F.lit("-"), F.lit("_"))
    out = F.when(F.coalesce(raw, F.lit("")) == "", "hoso_gis")
    for group, names in GROUPS.items():
        out = out.when(low.isin(*names), group)
    return out.otherwise("other")


def json_safe(values: Column) -> Column:
    """A map of doubles with NaN and the infinities as nulls."""
    return F.transform_values(values, lambda _, v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v))


def unwrap_json(text: Column, levels: int = 3) -> Column:
    """Text of a JSON value that was encoded as a JSON string up to so many times."""
    for _ in range(levels):
        text = F.when(text.rlike(r'^\s*"'), F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]).otherwise(text)
    return text


def canonical_json(properties: Column) -> Column:
    """A map as JSON with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(properties))))


def merge_first(a: Column, b: Column) -> Column:
    """Map of both; where a has a key, a's value stays."""
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)), a)


def merge_last(a: Column, b: Column) -> Column:
    """Map of both; where b has a key, b's value wins."""
    return merge_first(b, a)


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def official(level: Column) -> Column:
    return level.isin(*OFFICIAL)


def content_digest(row_hash: str = "h", buckets: int = 64):
    """Order-insensitive digest in two levels: rows' hashes by bucket, then bucket digests. Returns (bucket column, inner
    aggregate, outer aggregate) for groupBy(keys, bucket) and groupBy(keys)."""
    bucket = F.pmod(F.conv(F.substring(row_hash, 1, 6), 16, 10).cast("int"), F.lit(buckets))
    inner = F.sha2(F.concat_ws("", F.sort_array(F.collect_list(row_hash))), 256)
    outer = F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("bucket", "digest"))), lambda s: s["digest"])), 256)
    return bucket, inner, outer

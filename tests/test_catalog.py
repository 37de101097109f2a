"""Registered queries against their DuckDB SQL on the smallest tables."""

import os

import pytest

from landloom.plans import catalog
from tests.compare import difference, oracle_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAST = ["vn_normalize", "parse_coordinates", "canonical_url", "search", "text_candidates", "document_metadata", "content_digest", "layer_match", "point_query", "points_in_polygons", "area_m2", "tile_cover", "hilbert_id", "provenance_bfs", "georef_consensus", "consecutive_failures", "scheduler_tick", "observation_cycle", "coverage_summary", "coverage_detail", "layer_diff", "changeset_summary", "supersedes", "admin_unit_match", "admin_unit_parents", "q_poly_overlap", "q_time_order", "q_geom_duplicate", "html_links", "sitemap", "feed", "geojson_read", "vector_normalise", "observation_stream", "stream_append"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert difference(got, oracle_rows(SF, catalog.ORACLES[name])) == ""


def test_every_query_is_registered_once_and_most_have_sql():
    assert len(catalog.QUERIES) > 150
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.ORACLES) > 0.9 * len(catalog.QUERIES)

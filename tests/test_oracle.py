"""Registered queries against their checking SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

from jobweave import checks  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTERED = checks.load()
# One query per area keeps the suite short; TEST_ALL=1 runs every one, as does tools/compare.py.
CORE = [
    "canonical_url", "board_root_key", "parse_date", "places", "dedupe_by_id", "merge_catalog", "dedupe_any_key", "upsert_overlay", "last_good",
    "decode_compact", "map_records", "classify", "section_profile", "keywords", "recommend", "search_weighted", "build_source_graph", "extract_links",
    "stage_transitions", "stream_transitions", "stream_refresh",
]
NAMES = list(REGISTERED.queries) if os.environ.get("TEST_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result, _, _ = compare.compare(spark, con, SF, name, REGISTERED.queries[name], REGISTERED.oracles.get(name))
    assert result.startswith(("ok", "rows-only")), result


def test_every_query_has_sql():
    assert set(REGISTERED.queries) == set(REGISTERED.oracles)

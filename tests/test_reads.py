"""Tables that are made once, and files that a task reads whole."""

import re

import pytest

from mediagrain import plans
from mediagrain.sources import exports


@pytest.mark.parametrize("name", ["v18_overall_quality", "v19_improvement_plan", "a16_artist_quality"])
def test_tracks_are_made_once(spark, name):
    """the plan over the written rows reads no line item again."""
    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("l_linenumber|l_partkey|l_suppkey", plan)


def test_xml_files_are_bounded(spark, tmp_path, monkeypatch):
    """an XML file is read by one task, so it holds a bounded number of rows."""
    monkeypatch.setattr(exports, "XML_ROWS", 10, raising=False)
    exports.write_table(spark.range(35).coalesce(1), str(tmp_path / "x"), "xml", row_tag="row")
    assert len(list((tmp_path / "x").glob("part-*"))) == 4
    assert spark.read.format("xml").option("rowTag", "row").schema("id long").load(str(tmp_path / "x")).count() == 35

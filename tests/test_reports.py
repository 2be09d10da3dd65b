from __future__ import annotations

import pytest

from quirespark.operators import classification, recognition
from quirespark.plans.reports import Provenance, as_dict, report

ORIGIN = Provenance("set-1", "1.0.0", "m", "2", "a" * 40)


def test_report_has_sorted_slices_and_explicit_nulls(spark):
    schema = "sample_id string, reference string, prediction string, identifier_type string, cohorts array<string>"
    samples = spark.createDataFrame([("1", "ab", "ab", None, ["z", "b"]), ("2", "ab", "ax", None, [])], schema)
    labels = spark.createDataFrame([("1", "INVOICE", "INVOICE", ["b", "c"])], "sample_id string, reference string, prediction string, cohorts array<string>")
    got = as_dict(report("ocr", ORIGIN, {"recognition": recognition.metrics(samples), "classification": classification.summary(labels)}))
    assert [s["cohort"] for s in got["slices"]] == ["b", "c", "z"]
    assert got["slices"][1]["recognition"] is None and got["slices"][2]["classification"] is None
    assert got["aggregate"]["recognition"][0]["cer"] == 0.25 and got["aggregate"]["recognition"][0]["identifier_exact_match_rate"] is None
    assert got["provenance"]["dataset_name"] == "set-1"


@pytest.mark.parametrize("bad", [{"dataset_name": "Set"}, {"dataset_version": "1"}, {"source_commit": "x"}, {"model_name": " "}])
def test_provenance_is_checked(bad):
    with pytest.raises(ValueError):
        Provenance(**{**ORIGIN.__dict__, **bad})

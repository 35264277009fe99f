"""What an inner function of a list needs is computed once a record, not once an element."""

import pytest
from pyspark.sql import functions as F

from shotlattice.operators import episodes, kits as K
from shotlattice.plans import catalogue


@pytest.mark.parametrize("reader, most", [(K.coverage, 1), (K.crowd, 1), (K.shot_scale, 1), (K.portrait, 1), (K.single, 1), (K.pace_arc, 3)])
def test_seconds_are_computed_once(spark, reader, most):
    assert str(reader()).count("timeline.segments") <= most


def test_widths_are_computed_once_and_rows_are_dealt(spark):
    assert str(episodes.reading_chunks(F.col("width"), F.col("height"))).count("height") == 1
    plan = catalogue.queries()["reading_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan

"""The grammar of written dates."""

from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from presswork.functions.dates import free_date, parse


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-05 10:00 EST", datetime(2024, 1, 5, 15)), ("Fri, 05 Jan 2024 10:10:10 BST", datetime(2024, 1, 5, 10, 10, 10)), ("20240105T101010Z", datetime(2024, 1, 5, 10, 10, 10)),
        ("01.02.2024", datetime(2024, 1, 2)), ("Monday, 1st January 2024 at 10am", datetime(2024, 1, 1, 10)), ("13/02/2024 5:06 pm", datetime(2024, 2, 13, 17, 6)),
        ("2/13/2024", datetime(2024, 2, 13)), ("Jan 5th, '24", datetime(2024, 1, 5)), ("5 March 71 10:10+05:30", datetime(1971, 3, 5, 4, 40)), ("Sept 9 2023", datetime(2023, 9, 9)),
        ("Thursday the 4th of July 2019, 23:59:59.5 GMT+0200", datetime(2019, 7, 4, 21, 59, 59, 500000)), ("12 am Jan 1 2024", datetime(2024, 1, 1)), ("12:30 p.m. Jan 1 2024", datetime(2024, 1, 1, 12, 30)),
        ("05-Jan-2024 07:08", datetime(2024, 1, 5, 7, 8)), ("2024 Jan", datetime(2024, 1, 1)), ("20240105", datetime(2024, 1, 5)), ("2024/13/02", datetime(2024, 2, 13)),
        ("31 Feb 2024", None), ("2024", None), ("10:00", None), ("5 Jan", None), ("Jan Feb 2024", None), ("tomorrow", None), ("13 pm Jan 1 2024", None), ("99999 Jan 2024", None), ("", None), ("1 " * 9000, None),
    ],
)
def test_forms(text, want):
    assert parse(text) == want


def test_column(spark):
    rows = spark.createDataFrame([("1 Jan 1969 at 1pm",), (None,), ("x",)], "t string").select(free_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [datetime(1969, 1, 1, 13), None, None]


@settings(max_examples=500, deadline=None)
@given(st.datetimes(datetime(1970, 1, 1), datetime(2068, 12, 31)), st.sampled_from(["%d %B %Y %H:%M:%S.%f", "%A, %b %d, %Y %I:%M:%S.%f %p", "%Y-%m-%d %H:%M:%S,%f", "%m/%d/%y %H:%M:%S.%f UTC", "%H:%M:%S.%f %b. %dth %Y"]))
def test_round_trips(moment, form):
    assert parse(moment.strftime(form)) == moment


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789 :.,/-+TZamp JanFebst'٣²", max_size=30))
def test_any_text_is_a_date_or_none(text):
    assert parse(text) is None or isinstance(parse(text), datetime)

import json

import pytest

from corpusloom.operators.requests import validated

Q = "q" * 2000


@pytest.mark.parametrize(
    "body, want",
    [
        ({}, ("missing", None, None)),
        ({"question": "  "}, ("missing", None, None)),
        ({"question": Q + "x"}, ("too_long", None, None)),
        ({"question": Q}, ("ok", Q, None)),
        ({"question": 5}, ("invalid", None, None)),
        ({"question": "q", "service": None}, ("invalid", None, None)),
        ([1], ("invalid", None, None)),
        ("nope", ("invalid", None, None)),
        ({"question": " q "}, ("ok", "q", None)),
        ({"question": "q", "service": " Blobs "}, ("ok", "q", "blobs")),
        ({"question": "q", "service": "XYZ"}, ("ok", "q", None)),
        ({"httpMethod": "OPTIONS", "body": "x"}, ("options", None, None)),
        ({"httpMethod": "POST", "body": json.dumps({"question": "q", "service": "blobs"})}, ("ok", "q", "blobs")),
        ({"httpMethod": "POST", "body": None}, ("missing", None, None)),
        ({"httpMethod": "POST", "body": "{broken"}, ("invalid", None, None)),
        ({"body": "null"}, ("invalid", None, None)),
        ("{", None),
        (None, None),
    ],
)
def test_validation(spark, body, want):
    raw = None if body is None else body if body == "{" else json.dumps(body)
    df = spark.createDataFrame([(1, raw, "x")], "n int, body string, question string")
    r = validated(df, services=spark.createDataFrame([("blobs",), ("blobs",), (None,)], "service string")).first()
    assert (r.outcome, r.question, r.service_filter) == (want or ("invalid", None, None))


def test_empty(spark):
    assert validated(spark.createDataFrame([], "body string")).count() == 0

import pytest

from tidemark.sources.concurrent import together


def test_results_by_name(spark):
    done = together({n: lambda n=n: spark.range(n).count() for n in (1, 2, 3)})
    assert done == {1: 1, 2: 2, 3: 3}
    assert together({}) == {}


def test_first_error_is_raised_after_all_have_ended():
    ended = []

    def fail():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        together({"a": fail, "b": lambda: ended.append("b")})
    assert ended == ["b"]

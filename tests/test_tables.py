"""Tables of steps: what is deleted when, and what stays."""

from pathlib import Path

import pytest

from arcwright.tables import scratch, stored


def there(df):
    return Path(df._path.removeprefix("file://")).exists()


def test_only_what_is_kept_stays(spark):
    outside = stored(spark.range(3), "outside")
    with scratch(spark) as keep:
        inner = stored(spark.range(4), "inner")
        with scratch(spark) as keep_too:
            deep = stored(inner, "deep")
            passed_on = keep_too(deep, "passed-on")
            assert there(deep) and there(inner)
        assert not there(deep) and there(passed_on) and passed_on.count() == 4
        result = keep(passed_on, "result")
    assert there(outside) and there(result) and result.count() == 4
    assert not there(inner) and not there(passed_on)


def test_an_error_leaves_nothing(spark):
    made = []
    with pytest.raises(RuntimeError, match="stop"), scratch(spark):
        made.append(stored(spark.range(2), "lost"))
        raise RuntimeError("stop")
    assert not there(made[0])
    assert there(stored(spark.range(1), "after"))

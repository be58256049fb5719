"""Property test: the as-of join equals a brute force on generated frames."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from test_asof import T0, brute, run

keys = st.sampled_from(["a", "b", None])
minutes = st.integers(min_value=0, max_value=3 * 24 * 60)


@settings(max_examples=16, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    reqs=st.lists(st.tuples(keys, minutes), min_size=1, max_size=25),
    mounts=st.lists(st.tuples(keys, minutes), min_size=0, max_size=25),
    window_min=st.integers(min_value=1, max_value=36 * 60),
    target=st.sampled_from([None, 1, 3, 10]),
    direction=st.sampled_from(["forward", "backward"]),
)
def test_asof_equals_brute_force(spark, reqs, mounts, window_min, target, direction):
    r = [(i, k, T0 + dt.timedelta(minutes=m)) for i, (k, m) in enumerate(reqs)]
    m = [(100 + i, k, T0 + dt.timedelta(minutes=x), None) for i, (k, x) in enumerate(mounts)]
    window = dt.timedelta(minutes=window_min)
    assert run(spark, r, m, window, direction, target) == brute(r, m, window, direction)

"""Functions go to executors that have no copy of the package."""

import serialis


def test_functions_travel(travels):
    travels(serialis)

"""Parameters of the registered queries (values that select non-empty,
non-trivial results on the driver's data; see FIXTURES.md)."""

ROUTE = "7"
SCORE_BELOW = 2000.0
DENSITY_ABOVE = 2.0
MIN_TRIPS = 5
Z_THRESHOLD = 3.0
TOP_N = 10

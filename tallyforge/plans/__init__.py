"""Named plans: published views and metrics, and the queries over the driver's tables."""

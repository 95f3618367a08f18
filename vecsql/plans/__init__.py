"""Planning, estimation and query suites."""

"""End-to-end plans (the reference's three entry points) and the query catalog."""

"""Example jobs (four end-to-end flows) and the registry of checked queries."""

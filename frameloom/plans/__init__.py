"""Pipeline specifications and the catalogue of queries."""

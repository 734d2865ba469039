"""Query plans over the driver tables (catalog), their SQL oracles and
partitioning/broadcast strategy helpers."""

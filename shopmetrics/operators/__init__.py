"""Generic DataFrame operators the metrics are composed from."""

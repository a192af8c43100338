"""Training-data pipeline operators. Nothing outside this subpackage imports it."""

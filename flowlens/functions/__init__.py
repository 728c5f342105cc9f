"""Column expressions: no I/O, no actions, safe inside any DataFrame or stream."""

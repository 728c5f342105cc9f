"""Batch operators: one module per stage of the flow-to-incident path."""

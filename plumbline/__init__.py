"""Auditable analytics on Spark: answers with declared sources, and operators to check them."""

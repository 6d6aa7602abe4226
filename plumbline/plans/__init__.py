"""The query algebra: plan nodes, and their compilation to one lazy DataFrame."""

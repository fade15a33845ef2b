"""Spark analytics for text matrices, vector neighbourhoods and plane clustering."""

"""Graph, point and tabular operators."""

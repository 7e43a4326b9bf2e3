"""Column functions: measures on coordinate arrays, projections, text and coercion."""

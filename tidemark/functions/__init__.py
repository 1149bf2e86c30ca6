"""Column functions: text keys, geodesy, geometry, weights."""

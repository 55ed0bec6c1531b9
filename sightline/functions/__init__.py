"""Column expressions: grid cells, geodesy, time bins and small scalar rules."""

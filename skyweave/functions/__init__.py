"""Column functions: geometry, time, decoding, units, names."""

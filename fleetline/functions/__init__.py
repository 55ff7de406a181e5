"""Column functions: service time, geometry, labels, scores.  All are native expressions."""

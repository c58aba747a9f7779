"""Column and DataFrame functions that the operators share."""

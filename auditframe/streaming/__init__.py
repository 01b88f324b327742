"""The row-wise operators on unbounded input."""

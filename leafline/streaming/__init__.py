"""Live views of runs as streaming queries."""

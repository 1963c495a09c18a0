"""NumPy kernels that run inside tasks or on small driver state."""

"""Column functions and the array kernels that run inside tasks."""

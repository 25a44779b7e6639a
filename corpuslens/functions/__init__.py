"""Column functions and small numpy kernels used inside Arrow batches."""

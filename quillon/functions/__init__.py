"""Scalar kernels used inside Arrow-batched functions and as column expressions."""

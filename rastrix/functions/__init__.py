"""Column functions: kernels, grids and map projections."""

"""Column expressions: hashing, scores, labels, paths, grid stencils."""

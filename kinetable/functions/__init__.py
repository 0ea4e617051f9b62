"""Column expressions: skeleton geometry, intervals, text rules, model outputs."""

"""Scalar functions of rules, as Column expressions over term structs."""

"""Dataflow analytics on DataFrames: scalar and list programs, reductions, task graphs, placement and lifecycle rules as queries."""

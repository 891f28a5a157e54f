"""Publications and pages as DataFrames: scan, plan, join, render, validate."""

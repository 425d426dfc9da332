"""The jobs: every function takes DataFrames and returns lazy DataFrames."""

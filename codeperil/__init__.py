"""codeperil: change-risk analytics over source code, expressed as Spark DataFrames."""

__version__ = "0.1.0"

"""Relational and econometric operators over Spark DataFrames."""

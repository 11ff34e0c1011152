"""Operators over the tables of assets: DataFrame in, DataFrame out."""

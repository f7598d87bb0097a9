"""Storefront facts as Spark DataFrames: extract, clean, store, query, compare."""

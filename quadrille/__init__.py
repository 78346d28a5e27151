"""Quadrille: framed spectral analytics over ordered tables, on PySpark."""

"""Scalar functions: Column to Column, and Arrow UDFs where no built-in has the semantics."""

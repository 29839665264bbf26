"""Scalar functions as Column expressions; everything stays inside the JVM except the similarity score."""

"""Scalar building blocks: Column in, Column out, JVM-side only."""

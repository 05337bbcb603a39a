"""Fusing and analysing the boxes of several 3-D object detectors, with Spark."""

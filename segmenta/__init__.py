"""Compositional event queries over detections, as Spark DataFrame plans."""

"""Lineage and root-cause analytics over many pipeline runs at once, as Spark DataFrame programs."""

"""A PySpark-native analytics engine for spatially resolved genomic count data."""

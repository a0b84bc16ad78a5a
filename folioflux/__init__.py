"""folioflux: a PySpark-native analytics engine for segmented text corpora."""

__version__ = "0.1.0"

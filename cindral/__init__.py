"""cindral: Spark-native operators for fire detections, series, cells, labels and corpora."""

__version__ = "0.1.0"

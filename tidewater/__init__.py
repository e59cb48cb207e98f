"""tidewater: a Spark-native analytics pipeline (landing -> staging ->
marts -> reports -> metrics) expressed as DataFrame plans."""

__version__ = "0.1.0"

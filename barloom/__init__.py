"""barloom: a PySpark-native engine for bar-shaped time series and the data they arrive in."""

"""lattica: Spark-native particle, mesh and spectral analytics."""

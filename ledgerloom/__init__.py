"""A PySpark-native engine for analysing scanned and digital financial documents."""

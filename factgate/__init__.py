"""PySpark-native fact governance and copy verification over DataFrames."""

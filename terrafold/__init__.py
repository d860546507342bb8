"""Spark-native planning, parcel and training-data analytics."""

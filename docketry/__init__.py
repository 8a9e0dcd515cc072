"""docketry: a Spark-native engine for verifying and segmenting document text."""

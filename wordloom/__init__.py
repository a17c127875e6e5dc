"""Spark-native text analysis: lexicons, n-gram models, segmentation, search, graphs and boundaries."""

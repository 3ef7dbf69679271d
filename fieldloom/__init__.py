"""Spark-native field matching: catalogs in, scored, ranked and calibrated pairs out."""

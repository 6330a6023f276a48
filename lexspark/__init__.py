"""A Spark-native engine for lexicon analytics over wiki dumps and text tables."""

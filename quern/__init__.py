"""quern: a Spark-native engine for experiment measurement and targeting evaluation."""

"""sparkloom: a Spark-native engine for text signals and daily time series."""

"""marlstone: a Spark-native semantic analytics engine."""

"""A PySpark-native network-forensics and corpus analytics engine."""

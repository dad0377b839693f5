"""Spark-native engine for reconciling, auditing and scoring structured claims."""

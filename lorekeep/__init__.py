"""lorekeep: a PySpark-native engine for curated, bilingual document corpora."""

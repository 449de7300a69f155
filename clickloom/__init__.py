"""Click models for web-search logs on Spark: ingest, train by EM, score, evaluate, export."""

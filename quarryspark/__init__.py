"""quarryspark: retrieval, evidence judgement and corpus preparation as Spark plans."""

"""tessella: a Spark-first analytics engine for reader studies, evidence checks and corpus preparation."""

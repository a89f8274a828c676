"""corpusloom: hybrid retrieval, document analytics and corpus preparation as Spark DataFrame plans."""

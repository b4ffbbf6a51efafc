"""corpusloom: text-corpus analytics, retrieval and answer evaluation as Spark plans."""

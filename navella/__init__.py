"""Fund-disclosure analytics and corpus preparation as Spark jobs."""

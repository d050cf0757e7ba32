"""Message-risk analytics on Spark: detection, labelling, evaluation and corpus preparation as DataFrame jobs."""

"""Evidence analytics on Spark: retrieval, chunking, matching, selection and composition as DataFrame operators."""

"""Set-oriented retrieval, answer assembly and text-corpus operators on Spark."""

"""recollect: retrieval, governance and corpus operators over long-lived knowledge, written as Spark DataFrame programs."""

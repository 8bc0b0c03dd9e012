"""fathom: text retrieval, retrieval evaluation and corpus preparation as PySpark DataFrame plans."""

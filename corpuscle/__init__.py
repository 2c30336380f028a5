"""Word and entity analytics over encyclopedia-style corpora, as Spark DataFrame plans."""

"""tessella: tissue-image alignment analytics expressed as Spark plans."""

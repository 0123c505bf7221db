"""tesserix: analytics, text curation and training-data operators expressed as Spark plans."""

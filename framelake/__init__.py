"""framelake: analytics over image-frame catalogues and text corpora, as Spark DataFrame jobs."""

"""gleaner: a content-curation analytics engine expressed as Spark DataFrame plans."""

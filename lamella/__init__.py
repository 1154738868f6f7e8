"""lamella: labelled-volume analytics expressed as Spark DataFrame plans."""

"""chronoweave: temporal graph and panel analytics expressed as Spark DataFrame plans."""

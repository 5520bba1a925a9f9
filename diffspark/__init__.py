"""diffspark: diffusion analytics on graphs, expressed as Spark DataFrame plans."""

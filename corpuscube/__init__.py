"""corpuscube: text-corpus and statistical-cube analytics as PySpark DataFrame plans."""

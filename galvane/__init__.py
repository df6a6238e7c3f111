"""Galvane: nowcasting analytics expressed as Spark DataFrame plans."""

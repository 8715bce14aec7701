"""Identity-document detection, masking and training-text preparation as Spark DataFrame operators."""

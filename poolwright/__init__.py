"""Evidence synthesis and data preparation as DataFrame operators."""

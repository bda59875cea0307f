"""plumbline: sensor characterisation and training-data preparation as keyed Spark plans."""

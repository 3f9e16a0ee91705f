"""sparkloom: multi-model analytics on ordinary Spark DataFrames."""

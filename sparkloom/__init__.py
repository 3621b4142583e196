"""sparkloom: catalog search and curation on Spark DataFrames."""

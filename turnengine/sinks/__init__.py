"""Writers of the file contracts. Directories of Parquet or JSON lines need no code here: df.write does them."""

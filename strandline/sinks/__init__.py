"""Writers for the text and Parquet layouts."""

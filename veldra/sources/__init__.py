"""Tables as versioned Parquet snapshots, and the catalog that names them."""

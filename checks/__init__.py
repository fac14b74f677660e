"""SQL that states each query's result independently, for comparison by DuckDB."""

"""User-level operators: DataFrame in, lazy DataFrame out."""

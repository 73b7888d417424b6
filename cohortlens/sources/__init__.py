"""Sources and sinks: explicit schemas, CSV and Parquet readers, the TESTDATA
adapter and create-table-as writers."""

"""Reading and writing of tables, champion records and predictions."""

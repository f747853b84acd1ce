"""paperlark: purchase-document analytics and training-data preparation on PySpark."""

"""feltloom: repeated observations of semi-structured documents, felted into stable feed items on Spark."""

"""genlex: Spark operators for lexicons, text corpora and gendered-language measures in French text."""

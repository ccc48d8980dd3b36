"""quillsift: a Spark-native engine for preference-data curation."""

"""groundset: Spark operators that build, audit and evaluate grounded question-answering datasets."""

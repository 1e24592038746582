"""quern: document search, de-duplication, labelling and training-data preparation on Spark."""

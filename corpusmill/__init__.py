"""corpusmill: DataFrame operators for preparing document collections, retrieving over them and evaluating the results."""

"""Volume files: readers and writers of array formats, and Spark data sources over them."""

"""brindle: question answering over heterogeneous structured data, on Spark."""

"""Training-data operators: archives, filters, classifiers, deduplication, mixing."""

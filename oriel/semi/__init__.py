"""Semi-structured Oracle types as JSON: generic values, object tuples, queue messages, signatures, recipients."""

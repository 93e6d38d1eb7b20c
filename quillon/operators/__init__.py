"""Statistics over long-form matrices: QC, normalisation, aggregation, moments, markers, correlation."""

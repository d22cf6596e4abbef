"""Training-data operators: deduplication, extraction, packing, decontamination and scans."""

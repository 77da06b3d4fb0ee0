"""Training-data operators: filters, de-duplication, decontamination and packing of a text corpus."""

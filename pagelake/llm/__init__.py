"""Training-data operators: licence scan, quality ledger, toxicity, n-gram
Jaccard join, exact and substring de-duplication, mixing, pseudonyms, archive
conversion and byte-level BPE.  Nothing outside this subpackage imports it."""

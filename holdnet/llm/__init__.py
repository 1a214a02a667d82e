"""Training-data pipeline operators: token counts, packing, LM scoring, secret scans, toxicity,
token-id files, chat formatting, benchmark decontamination, SimHash near-dedup, quality rules.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

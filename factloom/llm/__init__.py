"""Training-data operators: dedup, token files, language ID, BPE, LM scores, secrets, licenses, decontamination.

Nothing outside this subpackage imports it.
"""

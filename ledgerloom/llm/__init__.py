"""Training-data operators: near-dedup, substring dedup, secret scan,
SentencePiece codec, WARC, quality model and rules, decontamination,
license scan, suffix-array dedup, importance resampling, word-end BPE codec
and fill-in-the-middle. Nothing outside this subpackage
imports it; ``queries`` registers one query per operator."""

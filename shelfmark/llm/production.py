"""Parameters that queries and the pipeline share."""

LANGUAGES = ("en", "es", "de", "fr")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

"""Production parameters shared by the registered queries and the corpus pipeline."""

from __future__ import annotations

#: whole weights of the mixture's levels; names not listed weigh 1
MIX = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2, "fr": 2}}
MIX_SEED = 7


def piece_model() -> str:
    """Path of the public SentencePiece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_vocabulary() -> str:
    """Path of the public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

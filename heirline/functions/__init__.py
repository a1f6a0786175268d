from heirline.functions.scalar import (
    clamp_weight,
    content_of,
    content_text,
    own_payload,
    parent_payload,
    risk_level,
    round4,
    sha256_hex,
    type_rank,
)

__all__ = [
    "clamp_weight",
    "content_of",
    "content_text",
    "own_payload",
    "parent_payload",
    "risk_level",
    "round4",
    "sha256_hex",
    "type_rank",
]

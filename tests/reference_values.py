"""Values worked out in plain Python, which tests hold column functions against."""

import hashlib
import hmac


def python_transport_code(key: bytes, payload_type: int, payload: bytes) -> int:
    """X23 for one value."""
    digest = hmac.new(key, bytes([payload_type]) + payload, hashlib.sha256).digest()
    return {0: 1, 0xFFFF: 0xFFFE}.get(code := int.from_bytes(digest[:2], "little"), code)

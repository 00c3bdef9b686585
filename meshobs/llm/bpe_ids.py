"""Vocabulary files of byte-level BPE, and token ids of whole texts."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable
from functools import cache


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def read_json(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids by token, and special tokens, of a byte-level BPE file of the ``tokenizers`` library.

    The file writes each byte as a printable character: the printable Latin-1 ones stand for themselves,
    the others for 256 and up in order.
    """
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in found["added_tokens"] if t["special"]}
    return {bytes(byte[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in special}, special


@cache
def json_coder(path: str) -> Callable[[str], bytes]:
    """A worker's coder for a ``tokenizers`` file: text to little-endian unsigned 32-bit ids.

    Merging runs in ``tiktoken``'s engine on the file's own vocabulary, which takes a quarter of the time; ids of
    merged tokens rise in the order of the file's merges, so both give the same ids.
    """
    import public_tokenizers
    import tiktoken

    ranks, special = read_json(path)
    engine = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    marks = re.compile("|".join(map(re.escape, special)) or "(?!)")

    def encode(text: str) -> bytes:
        return array("I", engine.encode(text, allowed_special="all") if marks.search(text) else engine.encode_ordinary(text)).tobytes()

    return encode

"""Seeds by name, and the generators they feed."""

from __future__ import annotations

import hashlib
import json

import numpy as np

#: Fixed value: the text that published seeds are derived with.
PREFIX = "tfim-confirmatory-v2"


def named_seed(root: int, domain: str) -> int:
    """An unsigned 64-bit seed from a root and a domain's SHA-256; store it as decimal(20, 0)."""
    words = np.frombuffer(hashlib.sha256(f"{PREFIX}|{int(root)}|{domain}".encode()).digest(), "<u4")
    return int(np.random.SeedSequence([int(root), *(int(w) for w in words)]).generate_state(1, np.uint64)[0])


def generator(seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64DXSM(int(seed)))


def retry_seed(seed: int, attempt: int) -> int:
    return int(np.random.SeedSequence([int(seed), attempt]).generate_state(1, np.uint64)[0])


def stable_hash(*parts: object) -> str:
    """SHA-256 of the parts as compact ASCII JSON."""
    return hashlib.sha256(json.dumps(parts, separators=(",", ":")).encode()).hexdigest()


def hash_seed(*parts: object) -> int:
    return int(stable_hash(*parts)[:16], 16)


def canonical_json(value: object) -> bytes:
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode()

"""Content ids in their two spellings: base 58 (version 0) and base 32 (version 1)."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The alphabet of base 58 and the bytes before a SHA-256 digest in each version; fixed values.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
HASH_HEAD, V1_HEAD = b"\x12\x20", b"\x01\x70"


def base58(raw: bytes) -> str:
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def from_base58(text: str) -> bytes | None:
    n = 0
    for c in text:
        at = BASE58.find(c)
        if at < 0:
            return None
        n = n * 58 + at
    return b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def variants(cid: str | None) -> list[str]:
    """P25: the id as it is, its version 1 and its version 0, each once; only the former where it can't be read."""
    raw = (cid or "").strip()
    if not raw:
        return []
    multihash = None
    if raw.startswith("Qm") and len(raw) == 46:
        multihash = from_base58(raw)
    elif raw[0] in "bB":
        body = raw[1:].upper()
        try:
            found = base64.b32decode(body + "=" * (-len(body) % 8))
        except ValueError:
            found = b""
        multihash = found[2:] if found.startswith(V1_HEAD) else None
    if not multihash or len(multihash) != 34 or not multihash.startswith(HASH_HEAD):
        return [raw]
    v1 = "b" + base64.b32encode(V1_HEAD + multihash).decode().rstrip("=").lower()
    return list(dict.fromkeys([raw, v1, base58(multihash)]))


@F.pandas_udf(ArrayType(StringType()))
def id_variants(ids: pd.Series) -> pd.Series:
    """P25 over a column: base conversion has no built-in function, so batches go through Arrow."""
    return ids.map(variants)


@F.pandas_udf(StringType())
def version0(digests: pd.Series) -> pd.Series:
    """The version 0 id of SHA-256 digests."""
    return digests.map(lambda d: base58(HASH_HEAD + bytes(d)))

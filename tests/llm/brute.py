"""Plain versions of what the operators return, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def token_rows(docs, tokenizer, end_id):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer)
    out, start = [], 0
    for doc_id, text in sorted(docs):
        ids = tk.encode(text or "", add_special_tokens=False).ids + [end_id]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc_id, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    return out


def contamination_rows(docs, items, window=13, one_in=20):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def words(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return word.findall(lowered)

    windows = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item_id)
    lengths = sorted({len(w) for w in windows})
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                key = tuple(w[i : i + n])
                if key in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        listed = ",".join(sorted(map(str, found)))
        out.append(
            (doc_id, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and one_in * len(hit) >= len(w))
        )
    return out


def repeat_rows(docs, length, keep="none"):
    places = defaultdict(list)
    raws = [(d, (t or "").encode()) for d, t in docs]
    for k, (_, raw) in enumerate(raws):
        for i in range(len(raw) - length + 1):
            places[raw[i : i + length]].append((k, i))
    covered = [bytearray(len(r)) for _, r in raws]
    for at in places.values():
        for k, i in at if keep == "none" and len(at) > 1 else at[1:]:
            covered[k][i : i + length] = b"\x01" * length
    out = []
    for (doc_id, raw), c in zip(raws, covered, strict=True):
        kept = bytes(b for b, x in zip(raw, c, strict=True) if not x)
        out.append((doc_id, len(raw), sum(c), len(re.findall(b"\x01+", bytes(c))), hashlib.sha256(kept).hexdigest()))
    return out


def base_rows(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append(
            (doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)
        )
    return out


def simhash_rows(docs, shingle=3, tau=2):
    import xxhash

    fps = []
    for _, text in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k][0])
                root[b] = a
    return [(d, f"{f:016x}", docs[find(i)][0]) for i, ((d, _), f) in enumerate(zip(docs, fps, strict=True))]


def chat_rows(messages):
    talks = defaultdict(list)
    for conv_id, turn, role, text in messages:
        talks[conv_id].append((turn, role, text or ""))
    out = []
    for conv_id, turns in talks.items():
        turns.sort()
        joined = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv_id, len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def similar_roots(docs, shingle=5):
    """The least place of all texts that links of a shingle Jaccard similarity of 0.8 or more reach."""

    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}

    sets, root = [grams(t) for _, t in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root

"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def tokens(rows, path, end):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, end]
        out.append((key, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(rows):
    sets = [(k, shingle_set(t)) for k, t in rows]
    union, where, common = Union(), defaultdict(list), Counter()
    for i, (_, s) in enumerate(sets):
        for x in s:
            for j in where[x]:
                common[j, i] += 1
            where[x].append(i)
    for (i, j), n in common.items():
        if 100 * n >= 75 * (len(sets[i][1]) + len(sets[j][1]) - n):
            union.join(i, j)
    least = {}
    for i, (k, _) in enumerate(sets):
        r = union.find(i)
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return [(k, len(s), least.get(union.find(i)) if s else k) for i, (k, s) in enumerate(sets)]


def repeats(rows, length=50):
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(k, first.get(w, k))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < k:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m[0])]
    return [(name, a, b) for a, _, name, b in sorted(found)]


def pii(rows):
    out = []
    for k, t in rows:
        spans = base_spans(t)
        n = Counter(s[0] for s in spans)
        out.append((k, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in spans).encode()).hexdigest()))
    return out

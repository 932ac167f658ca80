"""Plain Python versions of the operators, and awkward tables to compare them on."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns that operators might use themselves
CLASHING = "keys string, ids string, tag long, node long, n_tokens long, bucket int, kept string, shard int, spans string, _text string, n long, size long"


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def awkward(seed: int = 7, n: int = 120) -> list[tuple]:
    """Texts with copies, near copies, shared passages, empty, null, short and long ones, odd characters."""
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "und", "été", "Ñandú", "zebra", "QUICK", "a", "b", "it's", "x9", "日本", "🙂", "e-mail", "!!"] + ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts: list[str | None] = [None, None, "", "", " ", "\n\t", "one", "one", "ONE", "two words", passage, passage]
    while len(texts) < n:
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 12, 40, 80, 200]))]
        kind = rnd.random()
        if kind < 0.15:
            texts.append(rnd.choice(texts))
        elif kind < 0.35:
            at = rnd.randint(0, len(words))
            cut = passage.split(" ")[rnd.randint(0, 20) : rnd.randint(40, 60)]
            texts.append(" ".join(words[:at] + cut + words[at:]))
        elif kind < 0.45:
            base = (rnd.choice([t for t in texts if t]) or "x").split(" ")
            base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            texts.append(" ".join(base))
        else:
            texts.append(rnd.choice([" ", "\n", "  ", " "]).join(words))
    texts += ["ab" * 400, "ab" * 300, "the the " * 150, " ".join(rnd.choice(vocabulary) for _ in range(6000)), "x" * 5000]
    ids: list[int | None] = rnd.sample(range(10 * n), len(texts))
    rows = [(i, t, rnd.choice(["en", None]), rnd.choice(["s1", "s2", None]), None if t is None else len(t)) for i, t in zip(ids, texts)]
    return rows


def documents(spark, rows, clash: bool = True):
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        for column in CLASHING.split(", "):
            name, kind = column.rsplit(" ", 1)
            df = df.selectExpr("*", f"cast(1 as {kind}) as {name}")
    return df.repartition(3)


def rows_of(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def windows(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def least_first(i):
    return -(1 << 63) if i is None else i


def exact_groups(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = Counter()
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out[(i, keep, len(ids), i == keep, sha(t or ""))] += 1
    return out


def suffix_kept(rows, window=50):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            g = b[p : p + window]
            first[g] = min(first.get(g, least_first(i)), least_first(i))
    out = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < least_first(i):
                gone[p : p + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[(i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)))] += 1
    return out


def substring_kept(rows, window=35):
    split = re.compile(r"[^\x20\x09-\x0D]+").findall
    seen = Counter(w for _, t, *_ in rows for w in windows(split(t or ""), window))
    out = Counter()
    for i, t, *_ in rows:
        words = split(t or "")
        gone = [False] * len(words)
        for p, w in enumerate(windows(words, window)):
            if seen[w] > 1:
                gone[p : p + window] = [True] * window
        out[(i, len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))] += 1
    return out


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(rows, items):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    known = defaultdict(set)
    for item, t in items:
        words = split((t or "").translate(_LOWER))
        if words:
            for w in windows(words, min(10, len(words))):
                known[w].add(item)
    lengths = {len(w) for w in known}
    out = Counter()
    for i, t, *_ in rows:
        words = split((t or "").translate(_LOWER))
        hit, found = [False] * len(words), set()
        for n in lengths:
            for p, w in enumerate(windows(words, n)):
                if w in known:
                    hit[p : p + n] = [True] * n
                    found |= known[w]
        names = sorted(str(x) for x in found if x is not None)
        out[(i, len(words), sum(hit), len(names), sha(",".join(names)), sum(hit) > 0)] += 1
    return out


def fingerprint(text):
    words = re.compile(rb"[^\x20\x09-\x0D]+").findall((text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows, bits=4):
    prints = [fingerprint(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                up[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        least[find(k)].append(i)
    name = {k: min(v, key=least_first) for k, v in least.items()}
    return Counter((i, f"{prints[k]:016x}", name[find(k)]) for k, (i, *_) in enumerate(rows))


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isascii() and c.isdigit()]
        doubled = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        if 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)

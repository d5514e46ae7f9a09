"""Small tables with every odd case, and plain versions of the operators' results."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wizards quietly mix jugs of black "
    "quartz and every page of this little book repeats nothing that was written before it except "
    "the names of the four towns beside the river where our story about a stubborn miller begins"
).split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(PROSE[i] + ("." if rng.random() < 0.1 else "") for i in rng.integers(0, len(PROSE), n))


def odd_documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, tk, spans): null fields, empty and long texts, exact and
    near copies, shared passages, repeated rows, one id with two texts, and clashing extra columns."""
    shared, base = prose(1, 60), prose(2, 120)
    words = base.split()
    near = " ".join([*words[:50], "CHANGED", *words[51:]])
    texts = [
        base, base, near, base.upper(), "", None, " \n\t ", "one two", shared, prose(3, 40) + " " + shared,
        prose(4, 30) + "\n" + shared + "\n" + prose(5, 30), prose(6, 6000), "ab" * 700, "x" + "ab" * 700,
        "naïve café 日本語 ​ 42\n" + prose(7, 50), "row 17 of 20 done", "row 18 of 20 done", "row 19 of 20 done",
        "row 20 of 20 done\n" + prose(8, 20), "row 21 of 21 done\nown line here", "\x1c a\x1d  b \r\n c\x85d",
    ]
    rows = [(i, t, "en", ["a", "b", None, "é"][i % 4], None, i % 3, "x") for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], (7, prose(9, 45), None, "a", 5, 1, "y"), (None, prose(10, 45), None, None, 5, 1, "y")]


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tk int, spans string"


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components_of(n: int, pairs) -> list[int]:
    """For each of n nodes the smallest one it can reach."""
    lab = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(lab[a], lab[b])
            changed |= lab[a] != low or lab[b] != low
            lab[a] = lab[b] = low
    return lab


def simhash_of(text: str | None, k: int = 4) -> int:
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def repeated_cover(sequences: list, n: int) -> list[list[bool]]:
    """Per sequence, the places covered by a window that also starts elsewhere."""
    key = lambda s, i: s[i : i + n] if isinstance(s, bytes) else tuple(s[i : i + n])
    count = Counter(key(s, i) for s in sequences for i in range(len(s) - n + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - n + 1):
            if count[key(s, i)] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


def mask(line: str) -> str:
    return re.sub(r"[^ ]*[0-9][^ ]*", "<*>", " ".join(x.decode() for x in line.encode().split()))


def kept_lines(docs: list[tuple], least: int, long: int | None = None) -> list[str]:
    """Texts without the lines of recurring templates, and without long lines of so many texts, but in
    the first document of each.  Only different texts count."""
    texts, first, leaf_texts, parts = defaultdict(set), {}, defaultdict(set), {}
    for i, text, *_ in docs:
        for line in (text or "").split("\n"):
            if m := mask(line):
                w = m.split(" ")
                leaf = (len(w), *w[:3])
                texts[m].add(text)
                leaf_texts[leaf].add(text)
                first[m] = min(x for x in (first.get(m), i, 1 << 60) if x is not None)
                parts[m] = leaf, w
    often = {m for m, (leaf, _) in parts.items() if len(leaf_texts[leaf]) >= least}
    holders = defaultdict(set)
    for m in often:
        for at, x in enumerate(parts[m][1]):
            holders[parts[m][0], at, x] |= texts[m]
    group = defaultdict(list)
    for m in often:
        leaf, w = parts[m]
        fixed = [len(holders[leaf, at, x]) >= max(least, len(leaf_texts[leaf]) / 4) for at, x in enumerate(w)]
        shown = tuple(x if f else "<*>" for x, f in zip(w, fixed, strict=True))
        group[(leaf, shown) if sum(fixed) / len(w) >= 0.5 else m].append(m)
    owner = {}
    for m, (_, w) in parts.items():
        if long and len(w) >= 50 and 2 * w.count("<*>") < len(w) and len(texts[m]) >= long:
            owner[m] = first[m]
    for members in group.values():
        if len(set().union(*(texts[m] for m in members))) >= least:
            owner |= dict.fromkeys(members, min(first[m] for m in members))
    return [
        "\n".join(x for x in (text or "").split("\n") if mask(x) not in owner or owner[mask(x)] == i)
        for i, text, *_ in docs
    ]

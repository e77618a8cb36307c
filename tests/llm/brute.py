"""Plain Python versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import hashlib
import re
import struct
from collections import defaultdict

import xxhash

TEXTS = [
    "The quick brown fox jumps over the lazy dog near the river bank today.",
    "the QUICK brown fox jumps over the lazy dog near the river bank today",
    "A line that stands in many documents and says nothing of its own at all.\nshort\n\n  \nshort\nAnother line that only stands here, once, and has words enough to count.",
    "A line that stands in many documents and says nothing of its own at all!\nshort\nWholly different words make up the rest of this short document, as it were.",
    None,
    "",
    "   \n\t ",
    "don't DON'T 's 're''ve I'll<|endoftext|>b <|ENDOFTEXT|> a|<b",
    "日本語 テスト１２３ ½² ÀÖ×÷ß İstanbul Σας é  x y",
    "one two three four five " * 8,
    "x" * 5000,
    "word " * 4000,
    "Passage " + " ".join(f"tok{k}" for k in range(80)) + " end",
    "Other start here " + " ".join(f"tok{k}" for k in range(80)) + " and another finish",
]


def documents(spark, extra: bool = True):
    """(doc_id, text, source): the texts, equal rows, a null key and a column whose name could clash."""
    rows = [(k, x, f"s{k % 2}") for k, x in enumerate(TEXTS)] + [(0, TEXTS[0], "s0"), (50, TEXTS[0], None), (None, TEXTS[1], "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", "'z' as value", "1 as n") if extra else df


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def jump(key, n):
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def fingerprint(text):
    w = words(lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(items, linked):
    """item -> smallest item reachable."""
    low = {x: x for x in items}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    items = list(items)
    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def edits(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(text, items):
    w = bench_words(text)
    hit, found = set(), set()
    for item, body in items:
        iw = bench_words(body)
        if not iw:
            continue
        n = min(13, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(found)


def encoded(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def quality(text):
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {p + k for v in places.values() if len(v) > 1 for p in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
    return *base, base[0] < 10 or 100 * base[4] > 20 * base[0]


def alignment(rows, a, b):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) by whole texts and single tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    from voltmesh.llm.token_alignment import bytes_of_a, bytes_of_b

    ta, tb = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
    ta.encode_special_tokens = True
    of_a, of_b = bytes_of_a(a), bytes_of_b(b)
    done, counts = [], defaultdict(int)
    for doc, text in rows:
        text = text or ""
        ids_a, ids_b = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        body = (" " + text).encode() if text else b""
        if b"".join(of_a[k] for k in ids_a) != body or b"".join(of_b[k] for k in ids_b) != body:
            ids_a, ids_b = [], []
        spans = []
        for ids, of in ((ids_a, of_a), (ids_b, of_b)):
            at, own = 0, []
            for k in ids:
                own.append((at, at + len(of[k]), k))
                at += len(of[k])
            spans.append(own)
        links, j = [], 0
        for s, e, k in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((k, spans[1][j][2]))
                j += 1
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        text_of = ";".join("|".join(",".join(str(k) for s, e, k in side if low <= s and e <= high) for side in spans) for low, high in zip([0, *shared[:-1]], shared)) if len(text) < 3000 else None
        if text_of is None:  # the same, by running through both lists once
            parts, i, j = [], 0, 0
            for high in shared:
                i2, j2 = i, j
                while i2 < len(spans[0]) and spans[0][i2][1] <= high:
                    i2 += 1
                while j2 < len(spans[1]) and spans[1][j2][1] <= high:
                    j2 += 1
                parts.append(",".join(str(x[2]) for x in spans[0][i:i2]) + "|" + ",".join(str(x[2]) for x in spans[1][j:j2]))
                i, j = i2, j2
            text_of = ";".join(parts)
        for x in links:
            counts[x] += 1
        done.append((doc, len(ids_a), len(ids_b), len(shared), links, hashlib.sha256(text_of.encode()).hexdigest() if ids_a else ""))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(doc, na, nb, ng, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha) for doc, na, nb, ng, links, sha in done]

"""Divergence of sources against plain counting over all terms and all pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest

from voltmesh.llm import divergence

from . import brute


def audit(rows, min_docs, top):
    """(lang, source, part, item, value, rank) from (lang, source, text) rows, with every term of every source."""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(text or ""))
        n[lang, source].update(w)
        df[lang].update(set(w))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, c in df[lang].items() if c >= min_docs)
        own = sorted(s for x, s in groups if x == lang)

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(sum((n[lang, s] for s in own), Counter()))
        p = {s: shares(n[lang, s]) for s in own}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(p[s][t], p[x][t]) for t in kept), x) for x in own if x != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return Counter(out)


def corpus():
    random.seed(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["É", "日本", "THE", "\U0001f642", "a1b"]
    rows = []
    for _ in range(300):
        lang = random.choice(["en", "de", None, "xx"])
        source = random.choice(["s0", "s0", "s0", "s1", "s2", None, ""]) if lang != "xx" else "only"
        low = random.randrange(40)
        rows.append((lang, source, " ".join(random.choice(words[low:]) for _ in range(random.randrange(25)))))
    rows += [("en", "s0", None), ("en", "empty", ""), ("zz", "a", "rare words alone"), ("zz", "b", None), ("zz", "c", "12 34"), ("en", "s1", "THE the " * 40)] + [rows[0]] * 12
    return rows


@pytest.mark.parametrize(("min_docs", "top"), [(10, 10), (1, 3), (60, 10)])
def test_audit(spark, min_docs, top):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "lang string, source string, text string, item string, value int").repartition(5)
    got = divergence.audit(docs, min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == audit(rows, min_docs, top)


def test_long_texts_in_parts(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{'abcde'[k % 5]}é{k % 3}x" for k in range(2000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "source": ["s"], "text": [text]})
    whole = divergence._counted(batch).to_pylist()
    monkeypatch.setattr(divergence, "SLICE", 100)
    by = lambda rows: sorted((r["term"], r["n"], r["docs"]) for r in rows)
    assert by(divergence._counted(batch).to_pylist()) == by(whole)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(docs).count() == 0


def test_nothing_is_kept(spark):
    docs = spark.createDataFrame([("en", "a", None), ("en", "b", "x"), (None, None, None)], "lang string, source string, text string")
    assert Counter(tuple(r) for r in divergence.audit(docs).collect()) == Counter({("en", "a", "pair", "b", 0, 1): 1, ("en", "b", "pair", "a", 0, 1): 1})

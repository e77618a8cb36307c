"""Licence scans against plain lists of words, and planted notices."""

import random

import pytest

from voltmesh.llm import licences

from . import brute

GRANT = licences.TEMPLATES[0].text


def scan(rows, templates=licences.TEMPLATES, rare=6):
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) word by word."""
    lists = [licences.words(x or "") for _, x in rows]
    df = lambda w: sum(w in x for x in lists)
    chosen = [sorted(set(licences.words(t.text)), key=lambda w: (df(w), w))[:rare] for t in templates]
    out = []
    for (doc, _), w in zip(rows, lists, strict=True):
        stands = lambda p, low=0, high=None: [i for i in range(low, (len(w) if high is None else high) - len(p) + 1) if w[i : i + len(p)] == p]  # noqa: B023, E731
        base = sorted((i, label) for p, label in licences.PHRASES.items() for i in stands(p.split()))
        labels, score = {label for _, label in base}, 0.0
        for t, own in zip(templates, chosen, strict=True):
            text = licences.words(t.text)
            hits = [(i - k, x) for i, x in enumerate(w) if x in own for k, y in enumerate(text) if x == y]
            for b in {b for b, _ in hits}:
                n = len({x for c, x in hits if b <= c <= b + 8})
                low, high = max(b, 0), min(len(w), b + 8 + len(text))
                if n >= -(-len(own) * 60 // 100) and all(stands(licences.words(p), low, high) for p in t.phrases):
                    labels.add(t.label)
                    score = max(score, n / len(own))
        out.append((doc, len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return out


def corpus():
    random.seed(5)
    filler = lambda n: " ".join(random.choice(["anhely", "eran", "the", "license", "software", "of", "and", "public", "free", "use"]) for _ in range(n))
    rows = [(k, x) for k, x in enumerate(brute.TEXTS)]
    for k, t in enumerate(licences.TEMPLATES):
        rows.append((100 + k, t.text))
        rows.append((200 + k, f"{filler(30)}. {t.text.upper()}! {filler(20)}"))
        rows.append((300 + k, "\n * ".join(t.text.split())))
        cut = t.text.split()
        cut.insert(len(cut) // 2, "by Anhely Eran and others")
        rows.append((400 + k, " ".join(cut)))
        rows.append((500 + k, " ".join(t.text.split()[: len(t.text.split()) // 2])))
        rows.append((600 + k, " ".join(random.sample(t.text.split(), len(t.text.split())))))
    rows += [(700, "MIT License, mit-license and the General Public License; apache\nlicense " * 3), (701, filler(300)), (None, GRANT), (100, licences.TEMPLATES[0].text), (702, "license " * 300)]
    return rows


def test_scan(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, word string").repartition(4)
    got = licences.scan(docs)
    assert got.columns[:3] == ["doc_id", "n", "word"]
    key = lambda r: tuple(str(x) for x in r)
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got.collect()), key=key)
    assert found == sorted(scan(rows), key=key)


def test_notices_are_found_and_clean_texts_are_left_alone(spark):
    rows = corpus()
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in enumerate(licences.TEMPLATES):
        for doc in (100 + k, 200 + k, 300 + k):
            best = {x.template: x for x in got[doc].licences}[t.name]
            assert t.label in got[doc].labels.split(",") and best.score >= 0.6 and best.end > best.start
    assert got[701].labels == "" and not got[701].licences
    assert got[700].base_labels == "apache,gpl,mit" and (got[700].n_base, got[700].first_word) == (12, 0)


def test_long_texts_are_matched_across_parts(spark, monkeypatch):
    import pyarrow as pa

    index = licences.Index(licences.TEMPLATES, {})
    text = "anhely " * 50 + GRANT + " eran" * 70
    whole = licences._codes(pa.array([text]), index.known)
    monkeypatch.setattr(licences, "SLICE", 40)
    parts = licences._codes(pa.array([text]), index.known)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert {(t, low) for _, t, low, _, _ in index.matches(*parts)} >= {(0, 50)}


def test_empty_tables_and_clashes(spark):
    docs = brute.documents(spark, extra=False)
    assert licences.scan(docs.limit(0)).count() == 0
    assert all(r.labels == r.base_labels for r in licences.scan(docs, templates=[]).collect())
    with pytest.raises(ValueError):
        licences.scan(docs.selectExpr("*", "1 as score"))

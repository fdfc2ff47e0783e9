import math

import pytest

from tessera.llm import language_id as li


def plain_slots(raw):
    """The slot of each byte trigram, by loops over 32-bit arithmetic."""
    mask = (1 << 32) - 1
    out = []
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = (a * 2654435761 & mask) ^ (b * 2246822519 & mask) ^ (c * 3266489917 & mask)
        out.append((h * 668265263 & mask) >> (32 - li.BITS))
    return out


def plain_prediction(model, text):
    """Family by the largest margin, then votes of the pairs within it."""
    slots = plain_slots(text.lower().encode())
    margins = [sum(w[s] for s in slots) * 30.0 / max(len(slots), 1) + w[-1] for w in model.weights]
    sure = [1 / (1 + math.exp(-4 * m)) for m in margins]
    fams = len(model.family_rows)
    family = max(range(fams), key=lambda f: margins[f]) if fams else 0
    total = {i: 0.0 for i in range(len(model.langs)) if model.of[i] == family}
    pairs = {(a, b): fams + k for k, (a, b) in enumerate(model.pairs) if a in total}
    for (a, b), k in pairs.items():
        total[a if margins[k] >= 0 else b] += 1
        total[a] += 0.5 * math.tanh(margins[k]) / len(model.langs)
        total[b] -= 0.5 * math.tanh(margins[k]) / len(model.langs)
    best = max(total, key=total.get)
    score = sure[family] if fams else 1.0
    for (a, b), k in pairs.items():
        score *= sure[k] if a == best else 1 - sure[k] if b == best else 1
    return model.langs[best], score


def test_query_against_a_plain_scorer(spark, sf):
    from tessera.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = li.fit(docs.where(~li.held_out(docs["doc_id"])))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == (li.UNKNOWN, 0.0)
            continue
        lang, score = plain_prediction(model, text)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-6)

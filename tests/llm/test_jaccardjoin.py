from collections import defaultdict

import numpy as np
import pyarrow as pa

from folioforge.llm import jaccardjoin as J
from folioforge.llm.common import bytes_of


def brute(rows):
    grams = []
    for doc, text in rows:
        w = (text or "").lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if grams[i] and grams[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 62)
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], doc)
    return sorted((doc, least[find(k)], links[k]) for k, (doc, _) in enumerate(rows))


def changed(text, at):
    w = text.split()
    w[at % len(w)] = "changed"
    return " ".join(w)


def test_against_brute_force(docs, prose):
    rows = [(k, prose(120, k)) for k in range(15)]
    rows += [(100 + k, changed(prose(120, 3), 7 * k)) for k in range(12)] + [(200 + k, changed(prose(120, 4), 40)) for k in range(6)]
    rows += [(300, prose(120, 5).upper() + "  \n"), (301, "one two"), (302, "one  two"), (303, "one two three four five"), (304, ""), (305, None), (306, "  ")]
    found = sorted((r.doc_id, r.class_id, r.n_links) for r in J.near_duplicates(docs(rows)).collect())
    assert found == brute(rows)


def test_large_group_goes_block_by_block(docs, prose, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    rows = [(k, changed(prose(150, 1), 3 * k)) for k in range(40)]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in J.near_duplicates(docs(rows)).collect()) == brute(rows)


def test_odd_rows(docs, odd):
    found = J.near_duplicates(docs(odd)).collect()
    assert len(found) == len(odd)
    assert sorted((r.class_id, r.n_links) for r in found if r.doc_id == 4) == [(4, 1), (4, 1)]
    assert [(r.class_id, r.n_links) for r in found if r.doc_id is None] == [(None, 0)]
    assert J.near_duplicates(docs([])).count() == 0


def test_bands_reach_the_recall():
    b = J.bands_for(0.8, 7, 0.9995)
    assert 1 - (1 - 0.8**7) ** b >= 0.9995 > 1 - (1 - 0.8**7) ** (b - 1)


def test_sets_of_few_words():
    # A block may hold any few words in all, as where a short text comes last in a batch.
    for rows in [*([" ".join("abcdefgh"[:n])] for n in range(9)), ["a b", "c", ""], ["", "a", "b", "c d"], ["a", "b", "c"]]:
        grams, off = J.shingles(*bytes_of(pa.array(rows)))
        assert np.diff(off).tolist() == [max(1, len(t.split()) - 4) if t.split() else 0 for t in rows]
        assert len(grams) == off[-1]


def test_three_words_alone(docs):
    assert [tuple(r) for r in J.near_duplicates(docs([(1, "only three words")])).collect()] == [(1, 1, 0)]

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import suffixdedup as S


def brute(rows):
    seen, out, pending, last = set(), {}, [], None
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if doc != last:
            for b in pending:
                seen.update(b[p : p + S.SPAN] for p in range(len(b) - S.SPAN + 1))
            pending, last = [], doc
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - S.SPAN + 1):
            if b[p : p + S.SPAN] in seen:
                gone[p : p + S.SPAN] = b"\1" * S.SPAN
        pending.append(b)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.setdefault(doc, []).append((len(b), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def run(df):
    out = {}
    for r in df.collect():
        gone = sum(s.end - s.start for s in r.spans)
        out.setdefault(r.doc_id, []).append((r.n_bytes, gone, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("batch", [700, 1 << 20])
def test_against_brute_force(docs, prose, odd, monkeypatch, batch):
    monkeypatch.setattr(S, "BATCH_BYTES", batch)
    monkeypatch.setattr(S, "PART_BYTES", batch)
    a, b = prose(30, 1), prose(30, 2)
    rows = odd + [(10 + k, prose(20, 10 + k) + a + prose(5, 60 + k) + (b if k % 3 else "")) for k in range(12)]
    rows += [(40, a), (41, a + b), (42, "ab" * 100), (43, "ab" * 80 + "c"), (44, a[:49]), (45, a[:50]), (46, a[3:53] + "x" + a[3:53]), (46, a)]
    assert run(S.remove_repeats(docs(rows))) == brute(rows)


def test_empty(docs):
    assert S.remove_repeats(docs([])).count() == 0


def test_each_window_has_the_minimiser_of_its_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 400).astype(np.uint8)
    off = np.array([0, 150, 150, 180, 400])
    row, first, last, at = S.minimisers(data, off, S.SpanHash(data))
    windows = [(r, p) for r, f, l in zip(row, first, last) for p in range(f, l + 1)]
    assert windows == [(r, p) for r in range(4) for p in range(off[r], off[r + 1] - S.SPAN + 1)]
    assert all(f <= m + 0 and m + S.GRAM <= f + S.SPAN and l <= m for f, l, m in zip(first, last, at))


def test_levels_grow_geometrically():
    family = S.Family(np.minimum)
    keys = lambda *x: np.array([b"%03d" % k for k in x])
    for k in range(8):
        family.add(k, keys(*range(k * 10, k * 10 + 10)), np.full(10, k))
    assert [len(x.keys) for x in family.levels] == [80]
    family.add(8, keys(5, 500), np.array([-1, 8]))
    assert [len(x.keys) for x in family.levels] == [80, 2]
    level = family.whole()
    assert len(level.keys) == 81 and list(level.keys) == sorted(level.keys) and level.values[5] == -1
    assert all((level.keys[at] == keys(*(range(b * 10, b * 10 + 10) if b < 8 else (5, 500)))).all() for b, at in level.places)


def test_keys_spread_over_the_parts(prose):
    s = S.Suffixes(np.array([1]), pa.array([prose(4000, 1)]))
    sizes = np.bincount(S.dealt(np.unique(s.gram), 8))
    assert sizes.max() < 1.5 * sizes.min()


def test_suffixes_in_byte_order(prose):
    s = S.Suffixes(np.array([1]), pa.array([prose(400, 1)]))
    keys = np.sort(s.records(s.first, s.last, s.at))
    assert [bytes(k) for k in keys] == sorted(bytes(k) for k in keys)
    raw, r = s.data.tobytes(), s.records(s.first, s.last, s.at)
    for f, l, m, x in zip(s.first, s.last, s.at, r):
        assert bytes(x).startswith(raw[m : l + S.SPAN]) and bytes(x)[S.SPAN :].startswith(raw[f:m][::-1])


def test_hot_grams_are_dealt_by_window(docs, prose, monkeypatch):
    monkeypatch.setattr(S, "BATCH_BYTES", 900)
    monkeypatch.setattr(S, "PART_BYTES", 900)
    monkeypatch.setattr(S, "HOT", 3)
    common = prose(8, 1)
    rows = [(k // 2, prose(4, 100 + k) + " " + common + " " + prose(4, 200 + k // 3)) for k in range(30)]
    assert run(S.remove_repeats(docs(rows))) == brute(rows)


def test_rows_of_one_id_in_many_batches(docs, prose, monkeypatch):
    monkeypatch.setattr(S, "BATCH_BYTES", 400)
    a = prose(30, 1)
    rows = [(7, a + prose(9, k)) for k in range(12)] + [(3, prose(5, 99)), (None, a), (None, a + "x"), (9, a[:80]), (7, a)]
    assert run(S.remove_repeats(docs(rows))) == brute(rows)

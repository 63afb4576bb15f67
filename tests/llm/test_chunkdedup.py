import pytest

from folioforge.llm import chunkdedup as C


def brute(rows):
    """The same chunks, deduplicated one document after the other."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        import pyarrow as pa

        (raw, ends), = C.chunked(pa.array([raw.decode()]))
        own = set()
        gone = set()
        for a, b in zip([0, *ends], ends):
            d = C.digest(raw[a:b])
            if b - a >= C.LEAST:
                if d in seen:
                    gone.add(int.from_bytes(d[:8], "little", signed=True))
                own.add(d)
        out[doc] = C.without_repeats(raw, ends, gone)[0].decode()
        seen |= dict.fromkeys(own)
    return out


def test_against_brute_force(docs, prose):
    passage = prose(70, 99)
    rows = [(k, prose(60, k) + " " + (passage if k % 2 else "") + " " + prose(40, 100 + k)) for k in range(12)] + [(50, prose(60, 3)), (51, passage), (52, passage)]
    found = {r.doc_id: r for r in C.dedup_substrings(docs(rows)).collect()}
    assert {k: r.text for k, r in found.items()} == brute(rows)
    assert found[1].n_removed == 0 and all(found[k].n_removed > len(passage) / 2 for k in (3, 5, 7, 9, 11))
    assert found[51].text == "" or found[51].n_removed > len(passage) / 2
    assert all(found[k].n_removed == 0 for k in (0, 2, 4))


def test_insertion_moves_cuts_only_nearby(prose):
    text = prose(400, 8).encode()
    import pyarrow as pa

    ends = lambda b: next(iter(C.chunked(pa.array([b.decode()]))))[1]
    a, b = ends(text), ends(text[:100] + b"zz " + text[100:])
    assert {x + 3 for x in a if x > 300} == {x for x in b if x > 303}


def test_odd_rows(docs, odd):
    found = C.dedup_substrings(docs(odd)).collect()
    assert len(found) == len(odd)
    assert [r.text for r in found if r.doc_id == 1] == [None] and [r.text for r in found if r.doc_id == 4] == ["x", "x"]
    assert "clash" in found[0].did and C.dedup_substrings(docs([])).count() == 0


def test_chunks_cover_the_text(prose):
    import pyarrow as pa

    for text in (prose(300, 1), "é" * 3000, "", " " * 2000, "a b " * 900):
        raw, ends = next(iter(C.chunked(pa.array([text]))))
        assert b"".join(raw[a:b] for a, b in zip([0, *ends], ends)) == raw
        for a, b in zip([0, *ends], ends):
            raw[a:b].decode()


@pytest.mark.parametrize("n", [1, 2, 17])
def test_gear_is_the_rolling_hash(n):
    import numpy as np

    data = np.frombuffer(bytes(range(n)), np.uint8)
    want = 0
    for b in bytes(range(max(0, n - 16), n)):
        want = (want * 2 + int(C._GEAR[b])) % (1 << 32)
    assert int(C.gear(data)[-1]) == want


def test_cuts_do_not_depend_on_neighbours(prose):
    import pyarrow as pa

    texts = [prose(40, 1), "", prose(90, 2), "  x ", prose(90, 2)]
    together = [ends for _, ends in C.chunked(pa.array(texts))]
    assert together == [next(iter(C.chunked(pa.array([t]))))[1] for t in texts]


@pytest.mark.parametrize("kind", ["letters", "no-break", "encoded", "periodic"])
def test_text_without_white_space_is_cut_by_content(docs, kind):
    import random

    r = random.Random(3)
    make = {
        "letters": lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(n)),
        "no-break": lambda n: "".join(r.choice("abcdefg\u00a0") for _ in range(n)),
        "encoded": lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n)),
        "periodic": lambda n: "abcdefghij" * (n // 10),
    }[kind]
    passage = make(900)
    other = lambda n: "".join(chr(r.randrange(0x3B1, 0x3C9)) for _ in range(n))
    rows = [(1, other(200) + passage + other(200)), (2, other(77) + passage[:400] + "x" + passage[400:] + other(131))]
    found = {x.doc_id: x for x in C.dedup_substrings(docs(rows)).collect()}
    assert found[2].n_removed > 0.6 * len(passage.encode())
    ends = next(iter(C.chunked(__import__("pyarrow").array([rows[0][1]]))))[1]
    assert max(b - a for a, b in zip([0, *ends], ends)) < C.MOST


def test_a_single_repeated_chunk_is_removed(docs, prose):
    first = prose(120, 21)
    (raw, ends), = C.chunked(__import__("pyarrow").array([first]))
    a, b = next((a, b) for a, b in zip(ends[1:], ends[2:]) if b - a < 80)
    # The chunk with the bytes before it that its cuts depend on.
    near = raw[a - 44 : b + C.REACH].decode()
    rows = [(1, first), (2, prose(30, 22) + " " + near + " " + prose(30, 23))]
    found = {r.doc_id: r for r in C.dedup_substrings(docs(rows)).collect()}
    assert found[2].n_removed > 0 and raw[a:b].decode() not in found[2].text
    assert C.without_repeats(raw, ends, {int.from_bytes(C.digest(raw[a:b])[:8], "little", signed=True)}) == (raw[:a] + raw[b:], 1)

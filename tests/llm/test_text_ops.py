"""Substring dedup, SimHash and decontamination against brute force, with hostile rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyfold.llm import bitslice, textkit
from skyfold.llm.near_text import groups_of, keep_one
from skyfold.llm.simhash import fingerprints_of, links, near_duplicates, xxh64_spans
from skyfold.llm.components import components
from skyfold.llm.substring_dedup import COVERS, period_for, remove_repeats
from skyfold.llm.suffix_decontamination import Shard, ItemBlock, contamination, decontaminate

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, text string, lang string, block int, id long, hits string, bucket string"


def _docs(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "xx", 7, 8, "h", "b") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["ab", "Äö", "c", "dd", "e1", "FOO", "x" * 40, "ñ", "zz", "q-q"] + [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 40, 200]))]
        if i % 3 == 0:
            a = rng.randrange(30)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.choice([19, 20, 25, 30])]
        if i % 7 == 0:
            w += ["same"] * 45
        sep = rng.choice([" ", "  ", "\n", "\t "])
        out.append((rng.randrange(10**6) * 2 - 10**6, sep.join(w) + rng.choice(["", " ", "\n"])))
    out += [(3_000_001, out[0][1]), (3_000_003, out[3][1] + " tail"), (3_000_005, None), (3_000_007, ""), (3_000_009, " \t\n")]
    return out


def test_words_and_hashes_follow_the_bytes(texts):
    import pyarrow as pa

    column = pa.array([t for _, t in texts], pa.string())
    got = []
    for w in textkit.chunks(column, textkit.SPACED, lower=False, size=400):
        data = w.data.tobytes()
        got += [[data[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
        h = textkit.word_hashes(w)
        by = {}
        for s, e, x in zip(w.starts, w.ends, h.tolist()):
            assert by.setdefault(data[s:e], x) == x
        assert len(set(by.values())) == len(by)
    assert got == [(t or "").encode().split() for _, t in texts]


def test_covers_bring_any_two_places_together():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert period_for(20) == 13 and period_for(1) == 1


@pytest.mark.parametrize("window", [20, 3])
def test_substring_dedup_against_brute_force(spark, texts, window):
    got = {r["doc_id"]: r for r in remove_repeats(_docs(spark, texts), window, block_bytes=500).collect()}
    digest = {r["doc_id"]: r["kept_sha256"] for r in remove_repeats(_docs(spark, texts), window, block_bytes=5000, digest=True).collect()}
    seen = set()
    for i, t in sorted(texts):
        w = (t or "").split(None) if t is None else [x.decode() for x in t.encode().split()]
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(w), sum(gone), kept)
        assert digest[i] == hashlib.sha256(kept.encode()).hexdigest()


def test_substring_dedup_of_odd_tables(spark):
    assert remove_repeats(_docs(spark, [])).count() == 0
    text = " ".join(f"v{i}" for i in range(30))
    rows = remove_repeats(_docs(spark, [(None, text), (1, text), (1, text), (2, None)])).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(False, 0, 0), (True, 1, 30), (True, 1, 30), (True, 2, 0)]


def test_null_ids_are_dealt_over_blocks(spark):
    """Rows without an id come before all others, and of each repeated passage among them one stays."""
    passage = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(3)]
    rows = [(None, f"{passage[k % 3]} own{k} " + " ".join(f"t{k}x{i}" for i in range(25))) for k in range(30)] + [(5, passage[0]), (-(1 << 62), passage[1])]
    got = remove_repeats(_docs(spark, rows), block_bytes=500).collect()
    assert sum(r["doc_id"] is None for r in got) == 30
    assert sorted(r["n_removed"] for r in got if r["doc_id"] is None) == [0] * 3 + [30] * 27
    assert all(r["n_removed"] == 30 and r["kept_text"] == "" for r in got if r["doc_id"] is not None)


def test_xxh64_of_spans():
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog, again and again and again and again, for more than a hundred bytes", np.uint8)
    starts, ends = zip(*[(a, b) for a in range(0, len(data), 3) for b in range(a, len(data) + 1)])
    got = xxh64_spans(data, np.array(starts), np.array(ends))
    raw = data.tobytes()
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts, ends)]


def _fingerprint(text):
    w = (text or "").encode().translate(LOW).split()
    parts = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _smallest(ids, close):
    """Smallest id that each can reach."""
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in close:
            low = min(best[a], best[b])
            if best[a] != low or best[b] != low:
                best[a] = best[b] = low
                changed = True
    return best


def test_simhash_components_against_brute_force(spark, texts):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["a", "b", "Cc", "dd", "e"]) for _ in range(400)) for _ in range(4)]
    rows = list(texts)
    for k in range(40):
        w = base[k % 4].split()
        if k >= 4:
            w[rng.randrange(400)] = "changed"
        rows.append((5_000_000 + k, " ".join(w)))
    got = {r["doc_id"]: r for r in near_duplicates(_docs(spark, rows)).collect()}
    fps = {i: _fingerprint(t) for i, t in rows}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    ids = sorted(fps)
    best = _smallest(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {i: r["component_id"] for i, r in got.items()} == best
    assert len(set(best.values())) < len(ids)


def test_hot_keys_are_refined_without_losing_links(spark):
    rng = np.random.default_rng(0)
    # 3,000 fingerprints that agree in most bits, so that keys hold more than a group may
    values = {int(x) << 40 | 0x1234567890 for x in rng.integers(0, 1 << 14, 3000)}
    df = spark.createDataFrame([(v,) for v in values], "fp long").checkpoint()
    got = {(r["u"], r["v"]) for r in components(links(df, 2, 1024)).collect()}
    ordered = sorted(values)
    a = np.array(ordered, np.uint64)
    close = [(ordered[i], ordered[int(j)]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2) if j > i]
    assert {u: v for u, v in got} == {i: r for i, r in _smallest(ordered, close).items() if i != r}


def test_bit_sliced_pairs_against_popcounts():
    rng = np.random.default_rng(1)
    for w, radius in ((1, 2), (2, 0), (8, 84), (1, 3)):
        base = rng.integers(0, 1 << 63, (40, w)).astype(np.uint64)
        sigs = base[rng.integers(0, 40, 400)].copy()
        for k in range(400):
            for b in rng.integers(0, 64 * w, rng.integers(0, 2 * radius + 2)):
                sigs[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        group = np.sort(np.where(rng.random(400) < 0.4, 0, rng.integers(1, 60, 400)))
        got = set(zip(*(x.tolist() for x in bitslice.close_pairs(sigs, group, radius))))
        far = np.bitwise_count(sigs[:, None] ^ sigs[None]).sum(2)
        assert got == {(int(i), int(j), int(far[i, j])) for i, j in zip(*np.nonzero((far <= radius) & (group[:, None] == group))) if i < j}


def test_simhash_of_odd_tables(spark):
    assert near_duplicates(_docs(spark, [])).count() == 0
    rows = near_duplicates(_docs(spark, [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None), (8, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in rows) == [(0, 4), (4, 4), (4, 4), (8, 8), (9, 8)]
    long = "word " * 200_000
    assert near_duplicates(_docs(spark, [(1, long)])).first()["component_id"] == 1
    assert len(fingerprints_of(next(textkit.chunks(__import__("pyarrow").array(["x"]), textkit.SPACED, True)), 3)) == 1


def test_near_text_keeps_one_of_each_group(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(2000)]
    rows, group = [], {}
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([80, 300, 1000]))]
        for k in range(4):
            w = list(base)
            for _ in range(len(w) // 200 + (k > 0)):
                w[rng.randrange(len(w))] = "edited"
            i = 1000 * g + k
            rows.append((i, " ".join(w)))
            group[i] = g
    rows += [(90_000 + k, " ".join(rng.choice(words) for _ in range(100))) for k in range(50)]
    rows += [(95_000, None), (95_001, ""), (95_002, "one two"), (95_003, "one two"), (95_003, "one two"), (None, "one two")]
    kept = [r["doc_id"] for r in keep_one(_docs(spark, rows)).collect()]
    assert sorted(k for k in kept if k < 90_000) == [1000 * g for g in range(30)]
    assert sorted(k for k in kept if k >= 90_000) == [90_000 + k for k in range(50)] + [95_000, 95_002]
    few = {r["id"]: r["root"] for r in groups_of(_docs(spark, rows[:120]), group=16).collect()}
    assert len({few[i] for i in group}) == 30  # chunked groups lose no link
    assert keep_one(_docs(spark, [])).count() == 0 and keep_one(_docs(spark, rows)).columns == _docs(spark, []).columns


@pytest.mark.parametrize("group", [1024, 16])
def test_near_text_against_exact_similarity(spark, group):
    rng = random.Random(4)
    rows, sets = [], {}
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(150)]
        for k in range(40):
            w = list(base)
            for _ in range(rng.randrange(1, 5)):  # similarities from 0.6 to 0.95
                w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
            i = 100 * g + k
            rows.append((i, " ".join(w)))
            sets[i] = {tuple(w[s : s + 5]) for s in range(len(w) - 4)}
    close = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    want = _smallest(sorted(sets), close)
    by_root: dict[int, set[int]] = {}
    for r in groups_of(_docs(spark, rows), group=group).collect():
        by_root.setdefault(r["root"], set()).add(r["id"])
    expected: dict[int, set[int]] = {}
    for i, low in want.items():
        expected.setdefault(low, set()).add(i)
    assert 6 < len(expected) < 200
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, expected.values()))


def test_near_text_of_few_shingles(spark):
    """Short texts and copies without their last words, right at the similarity and right below it."""
    rows, linked = [], 0
    for words, less, many, link in ((9, 1, 200, True), (19, 3, 100, True), (29, 5, 50, True), (8, 1, 100, False), (18, 3, 50, False)):
        for k in range(many):
            w = [f"a{len(rows)}b{x}" for x in range(words)]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:-less]))]
        linked += link * many
    root = {r["id"]: r["root"] for r in groups_of(_docs(spark, rows)).collect()}
    pairs = [root[i] == root[i + 1] for i in range(0, len(rows), 2)]
    assert pairs == [True] * linked + [False] * (len(pairs) - linked)
    assert len(set(root.values())) == len(rows) - linked


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 30), (200, 2000)):
        i, j, far = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        few = bitslice.forest(n, i, j, far)
        parts = bitslice.components_of(n, i, j)
        assert (bitslice.components_of(n, i[few], j[few]) == parts).all() and len(few) == n - len(set(parts.tolist()))
        light = far <= 4
        assert (bitslice.components_of(n, i[light], j[light]) == bitslice.components_of(n, i[few][far[few] <= 4], j[few][far[few] <= 4])).all()


def _brute(rows, items, window):
    wins = {}
    for item, t in items:
        w = WORD.findall((t or "").encode().translate(LOW))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(LOW))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    v = [f"k{i}" for i in range(12)] + ["Über", "ÉA"]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([0, 2, 4, 5, 6, 12, 30])))) for i in range(25)] + [(99, None), (7, "dup. Item; twice")]
    rows = [(i, (" ,.!\n"[i % 5]).join(rng.choice(v + ["other", "none"]) for _ in range(rng.choice([0, 3, 50, 300])))) for i in range(60)] + [(70, None), (71, items[6][1])]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = _brute(rows, items, 5)
    for block in (8 << 20, 300):  # one round, and many
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination(_docs(spark, rows), frame, 5, block).collect()}
        assert got == want
    clean = decontaminate(_docs(spark, rows), frame, 5)
    assert clean.columns == _docs(spark, []).columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, x in want.items() if not x[1])
    assert contamination(_docs(spark, []), frame).count() == 0
    assert contamination(_docs(spark, rows), frame.limit(0)).filter("contaminated").count() == 0


def test_a_text_of_one_word_takes_bounded_memory():
    """Equal windows of an item are one, and places of one window are a run of words: 2 MB of one word against an item of 500."""
    import tracemalloc

    import pyarrow as pa

    from skyfold.llm.suffix_decontamination import _finished, _search

    test = ItemBlock.of([("1", "word " * 500), ("2", "word " * 20), ("3", "other " * 12)], 10)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["word " * 400_000, "other " * 11])], ["doc_id", "text"])
    tracemalloc.start()
    rows = [r for b in _search(iter([batch]), test, 10) for r in _finished(b, ["doc_id"]).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 << 20
    assert [(r["n_hit"], r["items"], r["longest"], r["spans"]) for r in rows] == [(400_000, ["1", "2"], 500, "0:400000"), (11, ["3"], 11, "0:11")]


def test_longest_matches_against_brute_force():
    from skyfold.llm.suffix_decontamination import longest_matches

    rng = np.random.default_rng(5)
    for n, m, letters in ((60, 40, 2), (200, 80, 3), (1, 1, 2), (50, 0, 2)):
        for _ in range(20):
            text, test = (np.where(rng.random(k) < 0.1, 0, rng.integers(1, letters + 1, k)) for k in (n, m))
            got = longest_matches(text, test)
            for i in range(n):
                best = 0
                for j in range(m):
                    k = 0
                    while i + k < n and j + k < m and text[i + k] == test[j + k] != 0:
                        k += 1
                    best = max(best, k)
                assert got[i] == best


def test_longest_match_and_spans(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    r = contamination(_docs(spark, [(1, "x A b, c d e f y a b c")]), items, 3).first()
    assert r["longest"] == 6 and r["spans"] == "1:7,8:11" and r["n_hit"] == 9
    again = contamination(_docs(spark, [(1, "x A b, c d e f y a b c")] * 2), items, 3)
    assert again.count() == 2
    assert Shard.__doc__ and ItemBlock.of([], 3).length.tolist() == []
    assert again.filter(F.col("contaminated")).count() == 2

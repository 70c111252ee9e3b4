import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm.shapes import LONG, ROWS, odd, rows_of
from pitwall.llm import substrings
from pitwall.llm.bwt import repeats
from pitwall.llm.components import components
from pitwall.llm.decontaminate import contaminated_out, contamination_hits
from pitwall.llm.simhash import links, simhash_groups
from pitwall.llm.substrings import remove_repeats


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: r for n, r in want.items() if n in linked}


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("long_list", [2, 64])
def test_links_lose_nothing(spark, bits, long_list):
    rng = np.random.default_rng(bits)
    values = set()
    for _ in range(15):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(30):
            values.add(x)
            for _ in range(int(rng.integers(1, 4))):
                x ^= 1 << int(rng.integers(0, 64))
    nodes = np.array(sorted(values), np.uint64)
    signed = nodes.view(np.int64).tolist()
    pairs = [(signed[i], signed[i + 1 + j]) for i, v in enumerate(nodes)
             for j in np.flatnonzero(np.bitwise_count(nodes[i + 1:] ^ v) <= bits).tolist()]
    got = components(links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, long_list))
    got = {r["node"]: r["root"] for r in got.collect()}
    assert {v: got.get(v, v) for v in signed} == roots(signed, pairs)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_of_odd_rows(spark):
    prints = {t: fingerprint(t) for _, t, *_ in ROWS}
    least = {}
    for i, t, *_ in ROWS:
        same = [j for j, u, *_ in ROWS if j is not None and (prints[t] ^ prints[u]).bit_count() <= 2]
        least[t] = min(same, default=None)
    want = sorted(((i, f"{prints[t]:016x}", least[t]) for i, t, *_ in ROWS), key=repr)
    assert rows_of(simhash_groups(odd(spark))) == want
    assert simhash_groups(odd(spark).limit(0)).count() == 0


def words(text):
    import re
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(table))


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        size = min(13, len(x))
        windows = {tuple(x[i:i + size]) for i in range(len(x) - size + 1)} if x else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i:i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "ça", "x1", "Öl", "der", "und"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(30)]
    items += [(100, None), (101, ""), (102, items[-1][1]), (102, items[-2][1]), (None, say(20)), (103, "the LAZY-dog")]
    texts = [*[r[:2] for r in ROWS], *[(200 + i, f"{say(5)}, {rng.choice(items)[1]}. {say(rng.randint(0, 300))}") for i in range(60)]]
    docs = odd(spark, [(*t, None, None, None) for t in texts])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(1))
    named = [(i, t) for i, t in items if t is not None]
    want = []
    for i, t in texts:
        n, h, found, bad = brute_hits(t, [x for x in named if x[0] is not None])
        full = brute_hits(t, named)
        want.append((i, n, full[1], len(found), ",".join(found), full[3]))
    got = contamination_hits(docs, bench).select(
        "doc_id", "n_words", "n_hit", "n_items", F.array_join("items", ","), "contaminated")
    assert rows_of(got) == sorted(want, key=repr)
    left = contaminated_out(docs, bench)
    assert left.columns == docs.columns
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in left.collect()])) == sorted(
        repr(t) for t, w in zip(texts, want) if not w[-1])
    assert contamination_hits(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert contamination_hits(docs.limit(0), bench).count() == 0


def test_repeats_of_short_texts():
    rng = np.random.default_rng(0)
    for _ in range(100):
        size = int(rng.integers(2, 7))
        parts = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 30)).astype(np.uint8) for _ in range(rng.integers(1, 8))]
        text = np.concatenate([np.append(p, np.uint8(255)) for p in parts])
        order, same = repeats(text, size)
        groups, raw = {}, text.tobytes()
        for g, p in zip(np.cumsum(~same).tolist(), order.tolist()):
            window = raw[p:p + size]
            if len(window) == size and b"\xff" not in window:
                groups.setdefault(g, set()).add(window)
        assert all(len(x) == 1 for x in groups.values())
        assert len(groups) == len(set().union(*groups.values(), []))


def brute_removal(rows, size):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1) if i is not None else ():
            first[b[p:p + size]] = min(i, first.get(b[p:p + size], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1) if i is not None else ():
            if first[b[p:p + size]] < i:
                gone[p:p + size] = b"\1" * size
        runs = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 1000, "long_group": 2, "part_bytes": 200}, {"length": 20},
                                     {"bucket_bytes": 1000, "common_least": 1}])
def test_repeated_substrings(spark, options, monkeypatch):
    if "common_least" in options:  # many anchors count as common
        monkeypatch.setattr(substrings, "SAMPLE", 2)
        monkeypatch.setattr(substrings, "COMMON", 10)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh") for _ in range(400))
    noise = lambda n: "".join(rng.choice("xyz") for _ in range(rng.randint(0, n)))
    rows = [r[:2] for r in ROWS] + [(7, LONG[1000:5000])]
    for i in range(60):
        a = rng.randint(0, 300)
        u = base[a:a + rng.randint(40, 100)]
        rows.append((rng.choice([100 + i, 50, None]), f"{noise(40)}{u}é--{u[3:]}{noise(30)}{u}"))
    docs = odd(spark, [(*r, None, None, None) for r in rows])
    got = remove_repeats(docs, **options).drop("kept")
    assert rows_of(got) == brute_removal(rows, options.get("length", 50))


def test_repeats_beyond_four_mebibytes(spark):
    rng = np.random.default_rng(5)
    say = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    passages = [say(300) for _ in range(3)]
    at = [(4 << 20) + 5, (8 << 20) + 11, substrings.PIECE - 150]  # the last across the end of a piece
    parts, end = [], 0
    for a, p in sorted(zip(at, passages)):
        parts += [say(a - end), p]
        end = a + len(p)
    long = "".join(parts) + say(1000)
    short = [(10 + i, f"{say(40)}.{p}.{say(40)}") for i, p in enumerate(passages)]
    for rows in ([(1, long), *short], [*short, (99, long)]):
        got = {r["doc_id"]: r for r in remove_repeats(odd(spark, [(*r, None, None, None) for r in rows])).collect()}
        least = rows[0][0]
        want = {i: 0 if i == 1 or i < 99 and least == 10 else 900 if i == 99 else 300 for i, _ in rows}
        assert {i: r["n_removed"] for i, r in got.items()} == want
        for i, t in rows:
            kept = t
            for p in passages if want[i] else ():
                kept = kept.replace(p, "")
            assert bytes(got[i]["kept"]) == kept.encode()


def test_pieces_have_the_windows_of_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    offsets = np.array([0, 3000, 3000, 3020, 7000, 7060])
    data = rng.integers(97, 99, 7060, np.uint8)

    def windows():
        doc, start, n, anchor, *_ = substrings._anchors(data, offsets, 50)
        return sorted((d, s + i, h) for d, s, n, h in zip(doc.tolist(), start.tolist(), n.tolist(), anchor.tolist()) for i in range(n))
    want = windows()
    monkeypatch.setattr(substrings, "PIECE", 256)
    assert windows() == want and len(want) == 2951 + 3931 + 11


def test_no_documents(spark):
    assert remove_repeats(odd(spark).limit(0)).count() == 0

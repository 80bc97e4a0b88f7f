"""Fill in the middle, periodic runs and SimHash groups against plain versions of them."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from finfacts.llm import fill_middle, runs, simhash
from finfacts.llm.shared import documents, ship_package
from finfacts.llm.wavelet import WaveletMatrix

DOCS = "doc_id long, text string, lang string, n long, form string, words long, runs string, key long, fingerprint string"
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}é" for i in range(30_000))
ODD = [(3, "A cat, a CAT;  naïvé \x1c x"), (1, None), (2, ""), (9, "  \n\t "), (5, LONG), (None, "no id"), (None, None), (7, "twice a b c d"), (7, "twice a b c d"),
       (7, "other"), (8, "x" * 5000), (10, "has <S> inside"), (11, "日本語 テスト 😀 a"), (12, "a " * 3000), (13, "a b c " * 40 + "d"), (14, "<P"), (15, "S>x")]


@pytest.fixture(scope="session", autouse=True)
def package(spark):
    ship_package(spark)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, "plain", 1, "r", 2, "f") for i, t in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in the middle -------------------------------------------------------------------------


def test_wavelet_matrix_counts_and_finds():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix = WaveletMatrix(symbols, 3)
        at = np.arange(n + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]
        places = np.flatnonzero(np.isin(symbols, (1, 4, 5)))
        nth = np.arange(len(places) + 1)
        found = matrix.locate((1, 4, 5), nth, np.zeros(len(nth), np.int64), np.full(len(nth), n))
        assert found.tolist() == [*places.tolist(), n]


def plain_fill(doc_id, text):
    text = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(5)
    alphabet = ["a", "é", "語", "😀", " ", "\n", "<", "P", "S", ">", "é"]
    rows = ODD + [(100 + i, "".join(rng.choices(alphabet, k=rng.randrange(40)))) for i in range(300)]
    got = [tuple(r) for r in fill_middle.fill_in_middle(docs_of(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted((plain_fill(*r) for r in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    digests = {tuple(r) for r in fill_middle.fill_in_middle_digests(docs_of(spark, rows)).collect()}
    assert digests == {(*w[:5], sha(w[5]), sha(t or "")) for w, t in ((plain_fill(*r), r[1]) for r in rows)}
    assert fill_middle.fill_in_middle_digests(docs_of(spark, [])).count() == 0


def test_words_are_units_too(spark):
    rows = [(i, f"  one two\nthree é{i} five ") for i in range(40)]
    filled = fill_middle.fill_in_middle(docs_of(spark, rows), unit="words", plain_percent=0)
    for doc_id, n, form, prefix, middle, output in map(tuple, filled.collect()):
        assert n == 5 and 0 <= prefix <= prefix + middle <= 5
        cut = output.split("<P>")[1].split("<S>")[0].split("<M>")[0]
        assert len(cut.split()) == prefix
    back = filled.select(F.col("doc_id"), fill_middle.restored(F.col("output"), F.col("form")))
    assert sorted(map(tuple, back.collect())) == rows


# --- periodic runs ------------------------------------------------------------------------------


def plain_runs(words, least_length=6, least_repeats=4):
    n, found = len(words), set()
    for q in range(1, n // least_repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_length, least_repeats * q):
                smaller = any(all(words[x] == words[x + p] for x in range(i, j + q - p)) for p in range(1, q))
                if not smaller:
                    found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found)


def plain_row(doc_id, text, plant):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if plant and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {x for s, length, q in found for x in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            words = []
            while len(words) < rng.randrange(0, 60):
                block = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
                words += block * rng.randrange(1, 7)
            docs.append(words)
        bounds = np.cumsum([0, *map(len, docs)])
        got = runs.periodic_runs(np.array([w for d in docs for w in d], np.int64), bounds, 6, 4)
        assert got.tolist() == [[b + s, length, q] for b, d in zip(bounds.tolist(), docs) for s, length, q in plain_runs(d)]


def test_collapsed_texts(spark):
    rng = random.Random(2)
    rows = ODD[:4] + ODD[5:] + [(i, " ".join(rng.choices("ab", k=rng.randrange(50))) + " z y x" * rng.randrange(6)) for i in range(100, 300)]
    got = [tuple(r) for r in runs.run_digests(docs_of(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(i, t, True) for i, t in rows), key=repr)
    assert sum(g[1] for g in got) > 50
    plain = {r["doc_id"]: r for r in runs.collapse_runs(docs_of(spark, [(1, "x y x y x y x y  end"), (2, LONG)])).collect()}
    assert plain[1]["collapsed"] == "x y end" and plain[1]["runs"] == [(0, 8, 2)]
    assert plain[2]["runs"] == [(0, 30_000, 977)] and len(plain[2]["collapsed"].split()) == 977
    assert runs.run_digests(docs_of(spark, [])).count() == 0


def test_runs_of_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).select("doc_id", "text").collect() if len((r["text"] or "").split()) < 600]
    got = [tuple(r) for r in runs.run_digests(docs_of(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(i, t, True) for i, t in rows), key=repr)


# --- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=4):
    """component_id of rows (doc_id, fingerprint) by comparing all pairs."""
    values = np.array(sorted({f for i, f in prints if i is not None}), np.uint64)
    part = np.arange(len(values))
    for i in range(len(values)):
        near = np.bitwise_count(values ^ values[i]) <= most
        part[np.isin(part, part[near])] = part[i]
    of = dict(zip(values.tolist(), part.tolist()))
    least = {}
    for i, f in prints:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    return [(i, f"{f:016x}", None if i is None else least[of[f]]) for i, f in prints]


def near_texts(n, rng):
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 5, 6, 30, 300)))] for _ in range(20)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9)}"
        rows.append((1000 + i, " ".join(words)))
    return rows


def test_simhash_equals_brute_force(spark):
    rows = ODD + near_texts(400, random.Random(7))
    rng = random.Random(8)
    rng.shuffle(rows)
    got = [tuple(r) for r in simhash.simhash_components(docs_of(spark, rows)).collect()]
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert 30 < len({w[2] for w in want}) < 350
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


def test_simhash_of_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).select("doc_id", "text").collect()]
    got = [tuple(r) for r in simhash.simhash_components(documents(spark, SF)).collect()]
    assert sorted(got) == sorted(plain_components([(i, plain_fingerprint(t)) for i, t in rows]))


@pytest.mark.parametrize(("block", "segments"), [(2048, None), (8, 5), (3, 7)])
def test_links_of_dense_groups(spark, block, segments):
    rng = random.Random(block)
    values = {rng.getrandbits(64) for _ in range(60)}
    for center in list(values)[:6]:
        for _ in range(60):
            x = center
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fingerprint long")
    pairs = simhash.near_links(frame, 4, block, segments).collect()
    part = {v: v for v in values}
    for a, b in pairs:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        old, new = part[b], part[a]
        part = {v: new if p == old else p for v, p in part.items()}
    want = plain_components([(v % (1 << 62), v) for v in sorted(values)])
    groups, wanted = {}, {}
    for (i, _, c), v in zip(want, sorted(values), strict=True):
        wanted.setdefault(c, set()).add(v)
        groups.setdefault(part[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_references_discard_most_pairs_of_chance():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 2000, np.uint64)
    table = simhash.distance_table(prints, simhash.references())
    one, two = np.triu_indices(2000, 1)
    left, other = simhash.survivors(table, one, two, 4)
    assert len(left) < 0.02 * len(one)
    near = np.bitwise_count(prints[one] ^ prints[two]) <= 4
    assert set(zip(one[near], two[near])) <= set(zip(left, other))
    pivots = simhash.references()
    assert all(int(x ^ y).bit_count() == 32 for i, x in enumerate(pivots) for y in pivots[:i])

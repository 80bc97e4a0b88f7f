"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from finfacts.llm import exact_dedup, html_text, huffman, jaccard, mixing, packing, pseudonyms, quality, url_rules, vptree
from finfacts.llm.shared import ship_package, split_by, with_offsets, without_listed
from finfacts.llm.tokens import word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, node string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def package(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def tokenizer():
    return Tokenizer.from_file(PATH)


def docs_of(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source), with columns whose names operators also use."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, None, 7, "x") for r in rows], DOCS)


LONG = " ".join(f"w{i % 977}é" for i in range(30_000))
ODD = [(3, "A cat, a CAT; it's 12-34 <|endoftext|> Ünïcode\u0301 \x1c x"), (1, None), (2, ""), (9, "  \n\t "), (5, LONG), (None, "no id"), (7, "twice"), (7, "twice"), (8, "x" * 5000)]


def encoded(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- tokens and files ---------------------------------------------------------------------------


def test_word_lookup_equals_the_tokenizer(tokenizer):
    import pyarrow as pa

    texts = [t for _, t in ODD] + ["it's ISN'T 'tis x'll", "ß ÉCOLE ŉ İI", "a.b,c!? (d) [e] $5 %%% ***", "日本語 テスト", "ﬁ ﬀ ½"]
    ids, lengths = word_ids(PATH).encode(pa.array(texts), 1)
    want = [encoded(tokenizer, t, 1) for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_files_round_trip(spark, tokenizer):
    got = [tuple(r) for r in huffman.huffman_round_trip(docs_of(spark, ODD), PATH, end=1).collect()]
    want, at = [], 0
    for doc_id, text in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encoded(tokenizer, text, 1)
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert huffman.huffman_round_trip(docs_of(spark, []), PATH).count() == 0


def test_files_are_decoded_from_what_was_written(spark, tokenizer):
    ids = huffman.token_ids(docs_of(spark, ODD), PATH, 1)
    code = huffman.global_code(ids)
    paths = [t.inputFiles() for t in (huffman.write_blocks(ids, code), huffman.write_lengths(spark, code))]
    del code, ids
    blocks, lengths = (spark.read.parquet(*p) for p in paths)
    assert lengths.columns == ["id", "length"]
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in huffman.read_blocks(blocks, lengths).collect())
    assert got == sorted((i or -1, len(e), crc(e)) for i, e in ((i, encoded(tokenizer, t, 1)) for i, t in ODD))


def test_code_is_optimal_and_limited():
    rng = np.random.default_rng(1)
    for counts, bits in ((np.array([5, 9, 12, 13, 16, 45]), 8), (2 ** np.arange(20), 6), (rng.integers(0, 9, 300), 9), (np.array([0, 4]), 3), (np.zeros(4, int), 4)):
        lengths = huffman.code_lengths(counts, bits)
        used = counts > 0
        assert lengths.max(initial=0) <= bits and not lengths[~used].any()
        assert (2.0 ** -lengths[used].astype(float)).sum() <= 1
    assert (huffman.code_lengths(np.array([5, 9, 12, 13, 16, 45]), 8) * [5, 9, 12, 13, 16, 45]).sum() == 224
    counts = rng.integers(0, 1000, 500)
    code = huffman.canonical(huffman.code_lengths(counts, 12))
    ids = rng.choice(np.flatnonzero(counts), 10_000)
    sizes = np.array([0, 1, 63, 64, 65, 9807])
    bits, marks = huffman.pack_bits(ids, sizes, code)
    offsets = np.cumsum([0, *map(len, bits)])[:-1]
    places = np.concatenate([8 * o + m for o, m in zip(offsets, marks, strict=True)])
    back = huffman.unpack_bits(np.frombuffer(b"".join(bits), np.uint8), places, huffman.checkpoint_sizes(sizes), code)
    assert (back == ids).all()


# --- exact duplicates ---------------------------------------------------------------------------


@pytest.mark.parametrize("most_cells", [1 << 29, 64])
def test_exact_duplicates(spark, most_cells):
    rows = [(1, "a"), (2, "a"), (9, None), (4, ""), (5, "b"), (6, "A"), (6, "A"), (None, "n"), (None, "n"), (8, LONG), (3, LONG), *[(100 + i, f"t{i % 40}") for i in range(80)]]
    got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(docs_of(spark, rows), most_cells=most_cells).drop("text_sha256").collect()), key=str)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = []
    for i, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep))
    assert got == sorted(want, key=str)
    kept = exact_dedup.drop_exact_duplicates(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, []).columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.where("doc_id is not null").collect()) == sorted({(k, t or "") for (_, t), (_, k, _, _) in zip(rows, want, strict=True) if k is not None})
    assert kept.where("doc_id is null").count() == 1
    assert exact_dedup.exact_duplicates(docs_of(spark, [])).count() == 0


def test_listed_rows_go_and_all_others_stay(spark):
    docs = docs_of(spark, [(i, f"t{i}") for i in range(300)] + [(None, "null id"), (7, "again")])
    listed = spark.createDataFrame([(7,), (8,), (999,)], "key long")
    kept = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in without_listed(docs, F.col("doc_id"), listed).collect())
    assert kept == sorted([(True, i) for i in range(300) if i not in (7, 8)] + [(False, 0)])
    clear, rest = split_by(docs, F.col("doc_id"), listed)
    assert clear.count() + rest.count() == 302 and rest.where("doc_id in (7, 8)").count() == 3


# --- near duplicates ----------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {b" ".join(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    return sorted((rows[i][0], len(sets[i]), min(least[find(i)])) for i in range(len(rows)))


def test_similar_components_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = rng.choices(words, k=rng.choice([5, 20, 60, 120, 200]))
        for _ in range(rng.choice([1, 2, 8, 30])):
            own = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    rows += [(2000, None), (2001, ""), (2002, "A b"), (2003, "a  B\n"), (2004, "b a"), (2005, "one two three four"), (2006, LONG), (2007, LONG + " more")]
    got = jaccard.similar_components(docs_of(spark, rows), 4, 85).collect()
    assert sorted(tuple(r) for r in got) == brute_components(rows, 4, 85)
    odd = jaccard.similar_components(docs_of(spark, [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")]), 4, 85).collect()
    assert sorted((tuple(r) for r in odd), key=str) == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1)], key=str)
    assert jaccard.similar_components(docs_of(spark, []), 4, 85).count() == 0


def test_one_of_each_group(spark):
    kept = jaccard.one_of_each_group(docs_of(spark, [(4, LONG), (2, LONG + " x"), (3, "other words stand here alone"), (1, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3] and kept.columns == docs_of(spark, []).columns


def test_class_words_count_only_by_themselves():
    def kinds(page):
        return [k for _, k in html_text.blocks(page)]

    for name in ("search-results-article", "comment-free", "social-studies", "shareholder", "notices-archive story", "adventure news"):
        assert kinds(f'<div class="{name}"><p>main text here</p></div>') == [html_text.OPEN], name
        assert kinds(f'<main><div class="{name}"><p>lesson</p></div></main>') == [html_text.CONTENT]
    for name in ("ad", "site-footer", "big sidebar", "commentList", "cookie_banner", "share-box", "NAV", "main-menu"):
        assert kinds(f'<div class="{name}"><p>main text here</p></div>') == [html_text.FURNITURE], name


def test_pseudonyms_are_valid_everywhere(spark):
    rng = random.Random(1)
    numbers = [f"{rng.choice([a for a in range(1, 900) if a != 666]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}" for _ in range(400)]
    dates = [f"{y:04}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}" for y in (1, 2, 150, 199, 200, 1000, 1799, 1800, 2213, 2214, 9000, 9799, 9800, 9999)] + ["0001-01-01", "9999-12-31"]
    secrets = ["0123456789ABCDEF" * 2, "0123456789abcdef" * 5, "0123456789ABCDEF" * 9]
    values = [*numbers, *dates, *secrets, "555.123.4567"]
    got = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymised(docs_of(spark, [(i, f"x {v} y") for i, v in enumerate(values)])).collect()}
    new = [got[i][2:-2] for i in range(len(values))]
    assert all(got[i].startswith("x ") and got[i].endswith(" y") and len(n) == len(v) for i, (n, v) in enumerate(zip(new, values, strict=True)))
    import re

    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", n) for n in new[:400])
    assert len(set(new[:400])) == len(set(numbers)) and sum(n == v for n, v in zip(new, values)) <= 2
    import datetime

    moved = [datetime.date.fromisoformat(n) for n in new[400:400 + len(dates)]]
    assert len(set(moved)) == len(set(dates)) and all((m.year - 200) // 400 == (int(d[:4]) - 200) // 400 for m, d in zip(moved, dates) if 200 <= int(d[:4]) < 9800)
    assert [re.fullmatch("[0-9A-F]+", n) is not None for n in new[-4:-1]] == [True, False, True] and re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", new[-1])


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    text = " ".join(f"w{i % 11}" for i in range(40))
    odd = [(1, text), (1, text), (2, None), (None, text + " y"), (None, None), (3, ""), (4, "  "), (5, "one of a kind"), (5, "and one more"), (6, LONG)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (odd, []):
        docs = docs_of(spark, rows).withColumnsRenamed({"size": "_cell", "node": "_key"}).withColumns({"_copies": F.lit(1), "_rows": F.lit("r"), "_place": F.lit(2.5)})
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert after.columns == docs.columns and (rows or after.count() == 0)
            if name == "exact_duplicates" and rows:
                assert sorted((r["doc_id"], r["text"] or "") for r in after.where("doc_id is not null").collect()) == [
                    (1, text), (4, "  "), (5, "and one more"), (5, "one of a kind"), (6, LONG)] or after.count() == 7
            if name == "packing":
                assert after.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_copies_of_rows_that_share_a_doc_id_do_not_depend_on_their_order(spark):
    rows = [(1, "a b c d", "s"), (1, "a b c e", "s"), (2, "x y", "t"), (3, "z", None)]
    got = [sorted((r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs_of(spark, rows[::step]).repartition(4)).collect()) for step in (1, -1)]
    assert got[0] == got[1] and got[0]


def test_texts_that_share_a_doc_id_are_told_apart(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (2, "all of this is another text"), (3, "a last one of its own"), (3, "a last one of its own"), (3, None)]
    docs = docs_of(spark, rows).withColumnsRenamed({"size": "_cell", "node": "_key", "lang": "text_hash"})
    kept = jaccard.one_of_each_group(docs)
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((i, t or "") for i, t in (rows[0], *rows[2:]))
    assert kept.columns == docs.columns
    same = docs_of(spark, [(5, text), (5, text + " more"), (9, text + " more")])
    assert sorted(r["doc_id"] for r in jaccard.one_of_each_group(same).collect()) == [5]
    got = jaccard.similar_components(docs_of(spark, rows), 5, 80).collect()
    assert sorted(r["component_id"] for r in got) == [1, 1, 2, 3, 3, 3]


def test_many_near_copies_that_differ_from_their_leader(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(60), rng.randrange(4)):
            own[at] = f"v{rng.randrange(30)}"
        rows.append((i, " ".join(own)))
    want = brute_components(rows, 5, 80)
    assert len({w[2] for w in want}) > 3
    for turns in (0, 3):
        monkeypatch.setattr(jaccard, "MOST_TURNS", turns)
        assert sorted(tuple(r) for r in jaccard.similar_components(docs_of(spark, rows), 5, 80).collect()) == want


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard.components(links, "path").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_long_word_and_pieces():
    long_word = "z" * (jaccard.PIECE_BYTES + 10)
    text = " ".join(f"w{i}" for i in range(100_000))
    a, b, c = jaccard.shingle_sets([text, f"{long_word} a b c", "A B c d"], 4)
    assert len(a) == 100_000 - 3 and len(b) == 1 and len(c) == 1
    assert (next(jaccard.shingle_sets(["w7 w8 w9 w10"], 4)) == a[np.searchsorted(a, next(jaccard.shingle_sets(["W7 w8 w9 w10"], 4)))]).all()


# --- packing ------------------------------------------------------------------------------------


def test_packing(spark, tokenizer):
    got = packing.pack_documents(docs_of(spark, ODD), PATH, end=0, capacity=256).collect()
    want = []
    for doc_id, text in ODD:
        ids = encoded(tokenizer, text, 0)
        want += [(doc_id, k // 256, k, len(ids[k:k + 256]), crc(ids[k:k + 256])) for k in range(0, len(ids), 256)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(docs_of(spark, []), PATH).count() == 0


def test_best_fit_closes_the_fullest():
    packer = packing.BestFit(10, 2)
    assert [packer.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert packer.open == 0 and packer.free == 0
    assert [packer.place(n) for n in (5, 8, 9, 5)] == [(2, 0), (3, 0), (4, 0), (2, 5)]


# --- mixing -------------------------------------------------------------------------------------


def water_level(sizes, weights, most):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        for s in over or free:
            target[s] = float(most * sizes[s]) if over else level * weight[s]
        rest -= sum(target[s] for s in over)
        free -= over or free
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 300])), rng.choice(["a"] * 9 + ["b", "c", "é", None])) for i in range(900)]
    rows += [(5000, None, "empty"), (5001, "x y", "b"), (5001, "x y", "b")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in docs_of(spark, rows).collect():
        by.setdefault(r["source"], []).append(len((r["text"] or "").split()))
    target = water_level({s: sum(v) for s, v in by.items()}, mixing.WEIGHTS, mixing.MOST_COPIES)
    source = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sum(by[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(by[s], default=0) * 2 + 1
    again = mixing.mix(docs_of(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mixed_documents(docs_of(spark, rows))
    assert out.columns == docs_of(spark, []).columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_offsets_are_running_sums(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i, i % 5) for i in range(200)], "g int, x int, v long")
    got = with_offsets(df, ("g",), (F.col("x").asc(),), F.col("v"), "before", "test").collect()
    sums = defaultdict(int)
    for r in sorted(got, key=lambda r: r["x"]):
        assert r["before"] == sums[r["g"]]
        sums[r["g"]] += r["v"]
    assert len(got) == 200


# --- pages --------------------------------------------------------------------------------------


def test_blocks_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><ul><li>Home<li>News</ul></nav>
    <div id=cookie-notice>We use cookies</div><!-- x > y --><article><header><h1>The &amp; head</h1></header><p>One&nbsp;two<br>three
    <p><b>un</b>split <i>x<p>last</i><script>var a="</p>";</script><section class='comments'><p>me too</p></section>
    <form><input name=q><button>Go</button></form></article><footer>&copy;</footer></body></html>"""
    assert [t for t, k in html_text.blocks(page) if k == html_text.CONTENT] == ["The & head", "One two three", "unsplit x", "last"]
    assert html_text.blocks(None) == [] and html_text.blocks("") == []
    assert [t for t, k in html_text.blocks("plain <b>text") if k == html_text.OPEN] == ["plain text"]
    assert html_text.blocks("<p>a<script>never closed") == [("a", html_text.OPEN)]


def test_embedded_elements_end_with_their_own_tag():
    def texts(page):
        return [t for t, _ in html_text.blocks(page)]

    for tag in ("<video-js></video-js>", "<audio-player>", "<object-view/>", "<svg/>", "<math />", "<iframe src='x'/>", "<video src=x>", "<svg class=a>"):
        assert texts(f"<p>before {tag} after<p>rest") == ["before after", "rest"]
    assert texts("<p>a<svg/>b<p>c<svg><text>no</text></svg>d") == ["ab", "cd"]
    assert texts("<p>a<svg x='1'><g/>no</SVG >b<iframe>no</iframe>c") == ["abc"]
    assert texts("<p>a<style>never closed <p>no") == ["a"] and texts("<p>a<script/>no</script>b<scripted>c") == ["abc"]


def test_repeated_runs_equal_brute_force():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 600)
    pages = np.sort(rng.integers(0, 9, 600))
    run = html_text.RUN
    where = defaultdict(set)
    windows = [i for i in range(600 - run + 1) if pages[i] == pages[i + run - 1]]
    for i in windows:
        where[tuple(words[i:i + run])].add(pages[i])
    want = np.zeros(600, bool)
    for i in windows:
        if len(where[tuple(words[i:i + run])]) >= html_text.PAGES:
            want[i:i + run] = True
    assert (html_text.repeated(words, pages) == want).all()
    assert not html_text.repeated(words[:3], pages[:3]).any()


def test_main_texts(spark):
    menu = "<div><p>home news sport weather travel money shop about us</p></div>"
    rows = [(1, "http://a.com/1", f"<body>{menu}<p>the first story stands alone here</p>"), (2, "http://a.com/2", f"<body>{menu}<p>the second one does so too</p>"),
            (3, "http://b.com/1", f"<body>{menu}<p>other host</p>"), (4, None, None), (5, "x", ""), (6, "http://c.com", "<article>A  b\n&lt;c&gt;</article><p>more")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_texts(pages).collect()}
    menu_text = "home news sport weather travel money shop about us"
    want = {1: "the first story stands alone here", 2: "the second one does so too", 3: f"{menu_text}\nother host", 4: "", 5: "", 6: "A b <c>"}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert html_text.main_texts(pages.limit(0)).count() == 0
    assert html_text.main_texts(pages.where("page_id < 3"), shard_chars=1).count() == 2


def prose(seed, n=60):
    rng = random.Random(f"prose {seed}")
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def texts_of(spark, rows, **more):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages, **more).collect()}
    assert len(got) == len(rows)
    return [got[i] for i in range(len(rows))]


def test_markup_is_evidence_only(spark):
    teaser = [f"<article>{prose(-i, 5)}</article>" for i in range(6)]
    rows = [("http://a.com", f"{t}<div>{prose(i)}</div>") for i, t in enumerate(teaser)]
    host = "subscribe now to read all of our stories for free"
    rows += [("http://b.com", f"<article><p>{prose(10 + i)}<p>{host}</article>") for i in range(6)]
    rows += [("http://c.com", f"<article><p>{prose(20 + i)}<p>{host if i < 4 else ''}</article>") for i in range(12)]
    got = texts_of(spark, rows)
    assert all(prose(i) in got[i] for i in range(6)), "an article of a few words does not silence the body"
    assert got[6:12] == [prose(10 + i) for i in range(6)], "what stands in most articles of a host is not theirs"
    assert got[12:16] == [f"{prose(20 + i)}\n{host}" for i in range(4)], "in a marked article a third of the pages is not enough"


def test_runs_are_counted_over_the_whole_host(spark, monkeypatch):
    notice = prose(-1, 12)
    rows = [("http://a.com", f"<p>{prose(i, 20)}<p>{notice if i % 8 == 0 else ''}<p>{prose(-2 - i % 40, 9)}") for i in range(400)]
    whole = texts_of(spark, rows)
    assert whole == [f"{prose(i, 20)}\n{prose(-2 - i % 40, 9)}" for i in range(400)], "on an eighth of the pages, and on a fortieth"
    assert texts_of(spark, rows, shard_chars=1) == whole
    monkeypatch.setattr(html_text, "SHARD_PAGES", 1)
    assert texts_of(spark, rows, shard_chars=1) == whole, "parts of a page or none"


def test_copies_and_quotations_stay(spark):
    quoted = prose(-1, 15)
    rows = [("http://a.com/1", f"<p>{prose(1)}"), ("http://a.com/1?print", f"<p>{prose(1)}"), ("http://m.a.com/", f"<p>{prose(2)}<p>back"), ("http://m.a.com/2", f"<p>{prose(2)}"),
            (None, f"<p>{prose(3)}"), ("no host", f"<p>{prose(3)}<p>other site"), (None, f"<p>{prose(3)}<p>third site")]
    rows += [("http://b.com", f"<p>{prose(10 + i)}<p>{quoted if i < 3 else 'none'}") for i in range(20)]
    got = texts_of(spark, rows)
    assert got[:4] == [prose(1), prose(1), f"{prose(2)}\nback", prose(2)]
    assert got[4:7] == [prose(3), f"{prose(3)}\nother site", f"{prose(3)}\nthird site"]
    assert got[7:10] == [f"{prose(10 + i)}\n{quoted}" for i in range(3)]


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h) or h == "") and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_rules(spark):
    rules = (*url_rules.RULES, ("block", "a.com", "/x"), ("allow", "a.com", "/x/y"), ("block", "b.a.com", "/x/"), ("allow", "com", "/xy/z/"), ("block", "", "/bad"))
    hosts = ["com", "a.com", "b.a.com", "c.b.A.com", "xa.com", "www.example.com", "example.com", "m.example.net", "net", "è.com", ""]
    paths = ["", "/", "/x", "/x/y/z", "/xy/z/1", "/x/?q=/x/y", "/en/1#t", "/es/", "/fr/2", "/bad/1", "?a", "#b"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "ftp://A.com/x://y", "http://a.com/x"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, urls[0], "h", "r"), (None, "http://a.com/x", "h", "r")], "page_id long, url string, host string, rule string")
    got = sorted((tuple(r) for r in url_rules.judged(pages, url_rules.rules_table(spark, rules), parts=3).collect()), key=str)
    want = [(i, *brute_verdict(u, rules)) for i, u in [*enumerate(urls), (0, urls[0]), (None, "http://a.com/x")]]
    assert got == sorted(want, key=str)
    none = url_rules.judged(pages, url_rules.rules_table(spark, rules).limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(want)
    assert url_rules.judged(pages.limit(0), url_rules.rules_table(spark)).count() == 0


# --- vectors ------------------------------------------------------------------------------------


def test_nearest_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2020, [0.0] * 6), (2040, [1.0, float("nan")] + [0.0] * 4), (2060, [None] + [1.0] * 5), (2080, []), (2100, [1.0]), (5, rows[5][1])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, score int")
    real = {i: np.array(v) for i, v in rows if i < 2000}
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        got = vptree.nearest(vectors, 20, 10, factor, shard=200).collect()
        found = defaultdict(list)
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            found[r["query_id"]].append((r["vec_id"], r["score"]))
        asked = [i for i in real if i % 20 == 0]
        assert sorted(found) == sorted(asked)
        hits = 0
        for q in asked:
            best = sorted(((round(-float(real[q] @ v), 9), i) for i, v in real.items() if i != q))[:10]
            hits += len({i for _, i in best} & {i for i, _ in found[q]})
            assert [r for _, r in found[q]] == sorted((s for _, s in found[q]), reverse=True) and len(found[q]) == 10
            if factor == 1.0:
                assert [i for i, _ in found[q]] == [i for _, i in best]
        assert hits >= least * 10 * len(asked)
    few = vptree.nearest(vectors.where("vec_id in (0, 1, 2)"), 20, 10).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert vptree.nearest(vectors.limit(0), 20, 10).count() == 0


# --- personal data ------------------------------------------------------------------------------


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms(spark):
    import re
    from datetime import date

    values = {"card": "4111 1111 1111 1111", "iban": "DE89 3704 0044 0532 0130 00", "mail": "jo.doe7@mail.example.com", "ip": "83.229.25.121", "phone": "+1 (974) 555-3436",
              "ssn": "123-45-6789", "day": "2024-02-29", "day2": "31/12/1999", "key": "ae93e105146691ae697923a219be4df655c4f1c7"}
    rows = [(i, f"one {v}, two") for i, v in enumerate(values.values())] + [
        (20, "all " + " ; ".join(values.values())), (21, None), (22, ""), (23, "4111 1111 1111 1112 and 999.1.1.1 on 2024-13-45 v1.2.3 id 12345"), (24, LONG), (0, rows0 := f"one {values['card']}, two")]
    out = pseudonyms.pseudonymised(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    text = {r["doc_id"]: r["text"] for r in out}
    assert text[21] is None and text[22] == "" and text[24] == LONG and text[23] == rows[len(values) + 3][1]
    made = {}
    for i, (name, v) in enumerate(values.items()):
        m = re.fullmatch(r"one (.*), two", text[i])
        made[name] = m[1]
        assert made[name] != v and re.sub("[0-9a-z]", "0", made[name]) == re.sub("[0-9a-z]", "0", v) or name == "ip"
    assert text[20] == "all " + " ; ".join(made.values()), "equal values stay linked"
    assert luhn(made["card"]) and all(int(x) < 256 for x in made["ip"].split("."))
    plain = made["iban"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain[:2] == "DE"
    date.fromisoformat(made["day"])
    assert pseudonyms.pseudonymised(docs_of(spark, rows), "other key").where("doc_id = 0").first()["text"] != text[0]
    assert pseudonyms.pseudonymised(docs_of(spark, [])).count() == 0 and rows0


def test_values_beside_other_numbers(spark):
    import re

    card, amex, iban = "4111 1111 1111 1111", "3782 822463 10005", "BE68 5390 0754 7034"
    texts = [f"{card} 12/25", "4111111111111111 123", f"order 12 {card}", f"{iban} EUR", f"1234 {card}", f"{card} 5500 0000 0000 0004", f"{card} 2024-02-29",
             f"no 7 {amex} 99", f"AB12 {iban} 1234", f"4111-1111-1111-1111 987", "4111111111111111@a.com", f"{card}"]
    got = [r for r in pseudonyms.pseudonymised(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    out = [r["text"] for r in got]
    assert [len(t) for t in out] == [len(t) for t in texts] and [r["n_replaced"] for r in got] == [1, 1, 1, 1, 1, 2, 2, 1, 1, 1, 1, 1]
    new = out[11]
    assert new != card and luhn(new)
    assert out[0] == f"{new} 12/25" and out[1] == new.replace(" ", "") + " 123" and out[2] == f"order 12 {new}" and out[4] == f"1234 {new}"
    assert out[5].startswith(f"{new} ") and luhn(out[5][20:]) and out[5][20:] != "5500 0000 0000 0004"
    assert out[6].startswith(f"{new} ") and re.fullmatch(r"\d{4}-\d\d-\d\d", out[6][20:]) and out[9] == new.replace(" ", "-") + " 987"
    assert re.fullmatch(r"BE\d\d \d{4} \d{4} \d{4} EUR", out[3]) and out[3][:19] != iban and out[8] == f"AB12 {out[3][:19]} 1234"
    assert out[7].startswith("no 7 ") and out[7].endswith(" 99") and luhn(out[7][5:22]) and amex not in out[7] and out[10].endswith("@a.com")


def test_long_mail_names_are_permuted_whole(spark):
    names = ["a" * 63 + "b" * 64 + "c" * 70 + e for e in ("x1", "x2", "")] + ["d" * 64, "d" * 65, "e" * 128, "f"]
    got = [r["text"] for r in pseudonyms.pseudonymised(docs_of(spark, [(i, f"to {n}@a.com!") for i, n in enumerate(names)])).orderBy("doc_id").collect()]
    assert [len(t) for t in got] == [len(n) + 10 for n in names] and all(t.startswith("to ") and t.endswith("@a.com!") for t in got)
    assert len(set(got)) == len(names) and got[0][:100] == got[1][:100] and got[0][137:203] != names[0][134:200]


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(7 * 11).select(F.array((F.col("id") / 11).cast("int"), (F.col("id") % 11).cast("int")).alias("v"))
    moved = pairs.select(pseudonyms.feistel(F.col("v"), F.array(F.lit(7), F.lit(11)), "k").alias("m")).collect()
    got = {tuple(r["m"]) for r in moved}
    assert got == {(a, b) for a in range(7) for b in range(11)}


# --- quality ------------------------------------------------------------------------------------


def test_quality_scores(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(800):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "river", "moves", "slowly", "past", "old", "houses"]) + ("" if good else rng.choice(["%%%", "$$$"])) for _ in range(rng.choice([3, 30, 200]))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    rows += [(5000, None), (5001, ""), (None, "a b c"), (5002, LONG)]
    table = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs_of(spark, rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    truth = {i: q for i, q, _ in labels}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]) > 0.95
    kept = quality.accepted_documents(docs_of(spark, rows), table)
    assert kept.columns == docs_of(spark, []).columns and 0 < kept.count() < len(rows)
    none = quality.quality_scores(docs_of(spark, rows[:5]), table.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(docs_of(spark, []), table).count() == 0


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(8)
    values, weights = rng.random(30), rng.integers(1, 5, 30).astype(float)
    fitted = quality.isotonic(values, weights)
    best = [max(min(np.average(values[a:b + 1], weights=weights[a:b + 1]) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(fitted, best)


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_duplicates", "near_duplicates", "mixing", "packing"]
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(stage(spark, results[-1], SF).cache())
    for r in results[1:-1]:
        assert r.columns == docs.columns
    scores = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, labels).collect()}
    first = {r["doc_id"]: r["text"] for r in results[1].collect()}
    assert set(first) == {i for i, p in scores.items() if p == 1}
    keep = {}
    for i, t in first.items():
        keep[t] = max(i, keep.get(t, i))
    second = {r["doc_id"]: r["text"] for r in results[2].collect()}
    assert set(second) == set(keep.values())
    third = {r["doc_id"] for r in results[3].collect()}
    assert third == {c for i, _, c in brute_components(list(second.items()), 5, 80) if i == c}
    copies = defaultdict(int)
    for r in results[4].collect():
        copies[r["doc_id"]] += 1
    assert copies == {r["doc_id"]: r["copies"] for r in mixing.mix(results[3]).collect() if r["copies"]}
    packed = defaultdict(int)
    for r in results[5].where("piece = 0").collect():
        packed[r["doc_id"]] += 1
    assert packed == copies
    for r in results[1:]:
        r.unpersist()

"""The ten operators against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from sumweave.llm import ann, decontaminate, fingerprint_index, license_scan, line_windows, packing, queries, reply_trees, simhash_tiles, url_reputation, zstd_langid
from sumweave.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, text_a string"
SF = "/root/testdata/sf0.001"


def docs_frame(spark, texts, langs=None):
    """Documents with two extra columns whose names clash with the operators' own."""
    langs = langs or [None] * len(texts)
    return spark.createDataFrame([(i, t, l, None, None, "k", "x") for (i, t), l in zip(texts, langs)], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(1, 160, 40)]
    passage = " ".join(rng.choice(vocab, 50))
    texts = base + base[:5] + [f"{base[7]} {passage} tail", f"head {passage}\n\tmore {passage}", "a " * 80, None, "", " \n\t ", "É à É", "x" * 5000]
    texts.append(" ".join(rng.choice(vocab, 3000)) + " " + passage)
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[12], (None, "no id here")]


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_repeats_match_brute_force(spark, corpus):
    got = fingerprint_index.remove_repeats(docs_frame(spark, corpus), window=35).collect()
    rows = [r for r in corpus if r[0] is not None]
    seen = Counter()
    for _, t in rows:
        w = blank_words(t)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for d, t in rows:
        w = blank_words(t)
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def test_repeats_in_parts_of_long_texts(spark, corpus):
    rows = lambda **more: sorted(map(tuple, fingerprint_index.remove_repeats(docs_frame(spark, corpus), window=35, **more).collect()))
    assert rows(part=40) == rows()
    assert [len(p) for _, p in fingerprint_index._parts([b"w"] * 100, 35)] == [100]
    parts = list(fingerprint_index._parts([b"%d" % i for i in range(100)], 35, 40))
    assert [x for at, p in parts for x in range(at, at + len(p) - 34)] == list(range(66))
    long = " ".join(f"w{i}" for i in range(250_000))
    got = {r.doc_id: r for r in fingerprint_index.remove_repeats(docs_frame(spark, [(1, "a " + long), (2, long + " b"), (3, "own words")])).collect()}
    assert {d: (r.n_words, r.n_removed, r.kept) for d, r in got.items()} == {1: (250_001, 250_000, "a"), 2: (250_001, 250_000, "b"), 3: (2, 0, "own words")}
    assert fingerprint_index.remove_repeats(docs_frame(spark, [])).count() == 0


def test_index_compacts_and_knows(spark):
    texts = [(i, " ".join(f"t{i}_{j}" for j in range(60))) for i in range(6)]
    index = fingerprint_index.FingerprintIndex(spark, 35, buckets=3, fanout=2)
    for i in range(4):
        index.ingest(docs_frame(spark, [texts[i]]))
        assert len(index.runs) <= 2
    total = index.merged()
    assert total.count() == total.select("fp").distinct().count() > 0
    known = index.known(docs_frame(spark, texts[3:5]))
    keys = {r.doc_id: r.k for r in docs_frame(spark, texts).select("doc_id", F.xxhash64("doc_id", "text").alias("k")).collect()}
    assert {r.key for r in known.collect()} == {keys[3]}
    index.drop()
    assert index.merged().count() == 0


def test_index_runs_join_without_shuffle(spark):
    texts = [(i, " ".join(f"t{i}_{j}" for j in range(60))) for i in range(4)]
    index = fingerprint_index.FingerprintIndex(spark, 35, buckets=3)
    for t in texts[:2]:
        index.ingest(docs_frame(spark, [t]))
    plan = index.merged()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()


def test_lines_match_brute_force(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb", None, "", "\n\n\n\n", "p\nq\nr\np\nq\nr", "a\nb\nc\nd", "é\na\nb\nc\nd\n"]
    rows = list(enumerate(texts)) + [(1, "x\na\nb\nc\ny"), (None, "a\nb\nc")]
    first, want = {}, {}
    for d, t in enumerate(texts):
        lines = t.split("\n") if t is not None else []
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if "".join(w).strip() and first.setdefault(w, (d, i)) != (d, i):
                gone |= {i, i + 1, i + 2}
        want[d] = (len(lines), len(gone), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    got = line_windows.remove_later_windows(docs_frame(spark, rows)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_lines, r.n_removed, r.kept) == want[r.doc_id], r


def test_lines_of_equal_ids_with_other_texts(spark):
    a, b = "x\ny\nz\nown a", "x\ny\nz\nown b"
    rows = [(1, a), (1, b), (1, b), (2, "x\ny\nz")]
    got = sorted((r.doc_id, r.kept) for r in line_windows.remove_later_windows(docs_frame(spark, []).limit(0).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert got in ([(1, "own b"), (1, "own b"), (1, a), (2, "")], [(1, "own a"), (1, b), (1, b), (2, "")])


def test_lines_of_very_long_texts(spark):
    own, shared = [f"own {i}" for i in range(20_000)], [f"shared {i}" for i in range(40_000)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(own + shared + own[:2]))]
    got = {r.doc_id: r for r in line_windows.remove_later_windows(docs_frame(spark, rows)).collect()}
    assert (got[1].n_removed, got[1].kept) == (0, rows[0][1])
    assert (got[2].n_lines, got[2].n_removed, got[2].kept) == (60_002, 40_000, "\n".join(own + own[:2]))


def test_simhash_matches_brute_force(spark, corpus):
    rng = np.random.default_rng(1)
    long = " ".join(f"v{i}" for i in rng.integers(0, 500, 400))
    near = [(1000 + i, long + f" extra{i}") for i in range(8)]
    rows = corpus + near + [(2000, "ONE two"), (2001, "one TWO")]
    want = {}
    for d, t in rows:
        if d is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        want[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    ids = sorted(want)
    comp = {d: d for d in ids}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (want[a] ^ want[b]).bit_count() <= 4 and root(a) != root(b):
                comp[max(root(a), root(b))] = min(root(a), root(b))
    got = simhash_tiles.near_duplicates(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows) - 1
    assert {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got} == {(d, want[d], root(d)) for d in ids}
    assert all(r.first == (r.doc_id == r.component_id) for r in got)
    texts = [" ".join(f"{x}{i}" for i in range(300)) for x in "abc"]
    same_id = simhash_tiles.near_duplicates(docs_frame(spark, [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (3, texts[0])])).collect()
    assert sorted((r.doc_id, r.first) for r in same_id) == [(1, True), (1, True), (1, True), (2, True), (3, False)]


@pytest.mark.parametrize("tile", [3, 4096])
def test_tiles_lose_no_link(spark, tile):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    fps = {0, -1, *base.tolist()}
    for b in base.tolist():
        for _ in range(15):
            b ^= (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63)))
            fps.add(b)
    fps = sorted(fps)
    links = simhash_tiles.link(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, tile, per_slice=2).collect()
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    want = {f: f for f in fps}

    def root2(f):
        while want[f] != f:
            f = want[f]
        return f

    for r in links:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4
        if root(r.a) != root(r.b):
            group[max(root(r.a), root(r.b))] = min(root(r.a), root(r.b))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and root2(a) != root2(b):
                want[max(root2(a), root2(b))] = min(root2(a), root2(b))
    assert {f: root(f) for f in fps} == {f: root2(f) for f in fps}


def test_links_of_a_large_group_stay_few(spark):
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 62, (450, 2))})
    links = simhash_tiles.link(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, 16, per_slice=2).collect()
    assert len(links) < 4 * len(fps)  # a forest for each pair of tiles would be some 20,000
    found = simhash_tiles.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(fps) and len({r.component for r in found}) == 1


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (20, 1)] + [(i, i + 1) for i in range(100, 140)] + [(500, 600 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 7: 7, 8: 7, 9: 7, **{i: 100 for i in range(100, 141)}, 500: 500, **{600 + i: 500 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_edges(spark, corpus):
    thirteen = "The quick, brown fox jumps over the lazy dog and runs far away"
    items = [(1, thirteen + " today"), (2, "Tiny item"), (3, None), (4, ""), (5, "tiny ITEM"), (None, "lost words"), (6, "É à É")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = corpus + [(900, "Start. " + thirteen.upper() + "! " + "filler " * 300), (901, "a tiny item"), (902, "tiny items"), (903, thirteen)]
    want = {}
    for d, t in rows:
        if d is None:
            continue
        w, hit, ids = alnum_words(t), set(), set()
        for i, x in items:
            g = alnum_words(x)
            m = min(13, len(g))
            grams = {tuple(g[j : j + m]) for j in range(len(g) - m + 1)} if g and i is not None else set()
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in grams:
                    hit |= set(range(j, j + m))
                    ids.add(i)
        want[d] = (len(w), len(hit), tuple(sorted(ids)), len(hit) > 0 and 20 * len(hit) >= len(w))
    for bound in (100_000, 0):
        got = decontaminate.decontaminate(docs_frame(spark, rows), bench, broadcast_rows=bound).collect()
        assert len(got) == len(rows) - 1
        for r in got:
            assert (r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) == want[r.doc_id]
    cleaned = {r.doc_id: r.cleaned for r in got}
    assert cleaned[900].startswith("Start! filler") and cleaned[902] == "tiny items" and cleaned[901] == "a"
    none = decontaminate.decontaminate(docs_frame(spark, rows), bench.limit(0)).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in none)


def test_decontamination_of_very_long_texts(spark):
    item, own = " ".join(f"w{i}" for i in range(40_000)), " ".join(f"v{i}" for i in range(20_000))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.decontaminate(docs_frame(spark, [(1, f"{own}. {item}, {own}")]), bench).first()
    assert (got.n_words, got.n_hit, got.contaminated, got.cleaned) == (80_000, 40_000, True, f"{own}, {own}")


NODES = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def test_reply_trees(spark):
    nodes = [
        (1, 1, None, "user", "q <|end|> \\ </s> [INST]", 0.0),
        (1, 2, 1, "assistant", "good\\", 3.0),
        (1, 3, 1, "assistant", "bad", 1.0),
        (1, 4, 2, "user", None, None),
        (1, 5, 4, "assistant", "<|sep|>é", 9.0),
        (2, 1, 99, None, "orphan", 1.0),
        (3, 1, 2, "user", "a", 0.0),
        (3, 2, 1, "user", "b", 0.0),
        (3, 3, 2, "user", "on a cycle", 0.0),
        (None, 1, None, "user", "x", 0.0),
    ] + [(4, i, i - 1, "user" if i % 2 else "assistant", f"m{i}", 0.0) for i in range(1, 40)]
    df = spark.createDataFrame(nodes + nodes[:2], NODES)
    every = reply_trees.format_trees(df, branches=None)
    told = reply_trees.with_loss_text(every).withColumn("turns", reply_trees.parse(F.col("formatted"))).collect()
    got = {(r.tree_id, r.leaf): r for r in told}
    assert set(got) == {(1, 3), (1, 5), (2, 1), (4, 39)}
    best = got[1, 5]
    assert best["rank"] == 1 and got[1, 3]["rank"] == 2
    assert [(t.role, t.text) for t in best.turns] == [("user", "q <|end|> \\ </s> [INST]"), ("assistant", "good\\"), ("user", ""), ("assistant", "<|sep|>é")]
    assert best.loss == "good\\<|sep|>é" and best.n_turns == 4
    body = re.sub(r"<\|(start|sep|end)\|>", "", best.formatted)
    assert not any(c in body for c in reply_trees.CONTROL)
    assert [t.text for t in got[4, 39].turns] == [f"m{i}" for i in range(1, 40)]
    assert reply_trees.format_trees(df).count() == 3
    assert reply_trees.format_trees(df.limit(0)).count() == 0


def test_reply_trees_of_many_leaves_and_turns(spark):
    """A chain with a leaf at each message: only the best path is enumerated."""
    nodes = [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"m{i} é𝄞", float(i % 5)) for i in range(300)]
    nodes += [(1, 1000 + i, i, "assistant", f"leaf {i}", 50.0 if i == 123 else 0.0) for i in range(300)]
    scores = {n: s for _, n, _, _, _, s in nodes}
    df = spark.createDataFrame(nodes, NODES).withColumns({"rank": F.lit(1), "leaf": F.lit("x"), "formatted": F.lit(2)})
    mean = lambda i: (sum(scores[k] for k in range(i + 1)) + scores[1000 + i]) / (i + 2)
    best = max(range(300), key=lambda i: (mean(i), -i))
    got = reply_trees.with_loss_text(reply_trees.format_trees(df)).withColumn("turns", reply_trees.parse(F.col("formatted"))).collect()
    assert len(got) == 1 and got[0].leaf == 1000 + best and got[0].mean_score == pytest.approx(mean(best)) and got[0].n_turns == best + 2
    assert [t.text for t in got[0].turns] == [f"m{i} é𝄞" for i in range(best + 1)] + [f"leaf {best}"]
    assert got[0].loss == "".join(f"m{i} é𝄞" for i in range(0, best + 1, 2)) + f"leaf {best}"
    levels, leaves = reply_trees.jumps(df)
    assert leaves.count() == 300 and reply_trees.paths(levels, leaves.filter(f"node_id = {1000 + best}").withColumnRenamed("node_id", "leaf")).count() == best + 2


def test_escape_round_trip(spark):
    texts = ["\\", "\\\\", "<|", "<\\|", "[INST][/INST]<<SYS>><</SYS>>", "a\nb\\\nc", "<<s>", "</s", "", "[\\INST]", "$1 \\$"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", reply_trees.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", reply_trees.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in reply_trees.CONTROL)


def test_packing(spark, corpus):
    path = queries.tokenizer_path()
    long = (700, "Word salad's  a\u00a0b " * 3000)
    rows = [(i, t) for i, t in corpus if i is not None] + [long, (701, "<|endoftext|> inside")]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = packing.pack(packing.pieces(docs_frame(spark, rows + [(None, "x")]), path, with_ids=True), group=20).toPandas()
    by_doc = defaultdict(list)
    for r in got.itertuples():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
    copies = Counter(d for d, _ in rows)
    for d, text in dict(rows).items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[d], key=lambda r: r.start)
        assert {r.doc_tokens for r in own} == {len(ids)}
        joined = b"".join(bytes(r.ids) * (k % copies[d] == 0) for k, r in enumerate(own))
        assert np.frombuffer(joined, "<u4").tolist() == ids
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert packing.pack(packing.pieces(docs_frame(spark, []), path)).count() == 0
    rows = [(1, 0, 3, 0), (1, 3, 2, 3), (2, 0, 4, 0), (3, 0, 8, 0)]
    pieces = [(s, o, n, np.arange(a, a + n, dtype="<u4").tobytes()) for s, a, n, o in rows]
    made = packing.sequences(spark.createDataFrame(pieces[::-1], "sequence_id long, offset long, length long, ids binary"), 8, 7).collect()
    told = {r.sequence_id: (r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in made}
    assert told == {1: (5, [0, 1, 2, 3, 4, 7, 7, 7]), 2: (4, [0, 1, 2, 3]), 3: (8, list(range(8)))}


def test_best_fit_decreasing():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 400)
    seq, off = packing.best_fit_decreasing(lengths, 100)
    left, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [k for k in range(len(left)) if left[k] >= lengths[i]]
        k = min(fits, key=lambda k: left[k]) if fits else len(left)
        if not fits:
            left.append(100)
        want[int(i)] = 100 - left[k]
        left[k] -= lengths[i]
    assert len(set(seq.tolist())) == len(left)
    assert Counter(off.tolist()) == Counter(want.values())
    assert packing.best_fit_decreasing(np.zeros(0, np.int64), 100)[0].size == 0


def test_license_base_and_labels(spark, corpus):
    mit = license_scan.TEMPLATES[0][1]
    mit = license_scan.TEMPLATES[1][1]
    edited = mit.replace("free of charge,", "totally free of any charge,").replace("limitation", "limit")
    rows = corpus + [(800, "Intro. MIT  License, mit-license mit license"), (801, "x y z " + edited), (802, "GNU General Public License CC-BY cc by 4"), (803, mit[:60]), (804, "the MIT License" + " foo" * 50)]
    rows.append((804, "the MIT License" + " foo" * 50))
    got = license_scan.scan(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows) - 1
    for r in got:
        texts = [t for d, t in rows if d == r.doc_id]
        w = alnum_words(texts[0])
        places, labels = [], set()
        for p, label in license_scan.PHRASES:
            p = p.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",") if r.labels else [])
        assert 0 <= r.score <= 1
    named = {r.doc_id: r for r in got}
    assert "mit-text" in named[801].labels and "mit-text" not in named[803].labels
    assert named[801].spans[0].start in (3, 4) and named[801].score < 1
    # a pair of neighbouring diagonals merges, whatever number of other matches starts between
    far = [(1000 * i, 50 + i, 60 + i) for i in range(1, 30)]
    groups = license_scan.merge_diagonals([(40, 45, 50), (43, 90, 95), *far], 4)
    assert [(40, 45, 50), (43, 90, 95)] in groups and len(groups) == 30
    many = license_scan.phrase_places([b"cc", b"by", b"x"] * 50_000)
    assert many == (list(range(0, 150_000, 3)), {"cc-by"})
    assert license_scan.scan(docs_frame(spark, [])).count() == 0


BROKEN = b"caf\xe9 \xff broken bytes"


def broken_frame(spark, rows):
    """doc_id, text: the last row's text is no UTF-8."""
    own = spark.createDataFrame(rows, "doc_id long, text string")
    bad = spark.createDataFrame([(999, bytearray(BROKEN))], "doc_id long, b binary").select("doc_id", F.expr("CAST(b AS STRING)").alias("text"))
    return own.unionByName(bad).select("doc_id", "text", F.lit("aa").alias("lang"))


def test_ill_formed_utf8_stops_nothing(spark):
    words = " ".join(f"w{i}" for i in range(50))
    df = broken_frame(spark, [(1, words), (2, "x " + words), (3, None)])
    pieces = BROKEN.split()
    got = {r.doc_id: r for r in fingerprint_index.remove_repeats(df).collect()}
    assert (got[999].n_words, got[999].n_removed) == (len(pieces), 0) and got[999].kept_sha256 == hashlib.sha256(b" ".join(pieces)).hexdigest()
    assert {r.doc_id for r in zstd_langid.identify(df, zstd_langid.fit(df)).collect()} == {1, 2, 3, 999}
    path = queries.tokenizer_path()
    packed = {r.doc_id: r for r in packing.pack(packing.pieces(df, path)).collect()}
    ids = packing.WordTokenizer(path).whole(BROKEN.decode("utf-8", "replace"))
    assert packed[999].doc_tokens == len(ids) // 4 + 1
    bench = spark.createDataFrame([(1, words)], "item_id long, text string")
    assert decontaminate.decontaminate(df, bench).count() == 4
    assert line_windows.remove_later_windows(df).count() == 4
    assert simhash_tiles.near_duplicates(df).count() == 4 and license_scan.scan(df).count() == 4


def test_language_matches_brute_force(spark):
    """Every text against every dictionary with a compressor of its own, over the table."""
    import zstandard

    docs = queries.documents(spark, SF)
    learned = zstd_langid.fit(docs.filter(~queries.held_out()))
    rows = docs.filter(~queries.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").distinct().collect()
    clean = lambda t: re.sub(r"[\W\d_]+", " ", t.lower())
    assert set(learned) == {r.lang for r in rows}
    for lang, own in learned.items():  # at most 96 of a language here and there: the dictionary is made of whole texts
        texts = [clean(r.text).strip() for r in rows if r.lang == lang]
        assert sum(t in own.decode() for t in texts) >= min(len(texts), 96)
    got = {r.doc_id: r for r in queries.op5_zstd_language(spark, SF).collect()}
    for r in docs.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score, got[r.doc_id].rejected) == ("und", 0.0, True)
            continue
        data, sizes = clean(r.text).encode(), {}
        for lang in sorted(learned):
            d = zstandard.ZstdCompressionDict(learned[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(3, write_checksum=False, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            press = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
            sizes[lang] = sum(len(press.compress(data[i : i + 2000])) for i in range(0, len(data), 2000))
        best, second = sorted((n, lang) for lang, n in sizes.items())[:2]
        assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == (best[1], 1 - best[0] / second[0])
        assert got[r.doc_id].rejected == (1 - best[0] / second[0] < 0.003)


def test_license_labels_of_planted_notices(spark):
    """Edited notices are found, scattered words of one and unlike texts are not; in parts as in whole."""
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(400)]
    rows, want = [], {}
    for label, text in license_scan.TEMPLATES:
        words = text.split()
        if len(words) < 25:
            continue
        for kind in ("whole", "edited", "scattered"):
            own = list(words)
            if kind == "edited":
                for at in sorted(rng.choice(len(own), len(own) // 30, replace=False), reverse=True):
                    own[at : at + 1] = [] if at % 2 else [own[at], "foreign"]
            if kind == "scattered":
                own = [x for i, w in enumerate(words) for x in ([w] + ["foreign", "words", "here"] * (i % 5 == 4))]
            around = [" ".join(rng.choice(vocab, 60)) for _ in range(2)]
            rows.append((len(rows), f"{around[0]} {' '.join(own)} {around[1]}"))
            want[rows[-1][0]] = (label, kind)
    rows += [(len(rows) + i, " ".join(rng.choice(vocab, 200))) for i in range(20)]
    rows.append((5000, "This work is licensed under CC BY-NC 4.0"))
    rows.append((5001, "word " * 300 + license_scan.TEMPLATES[2][1]))
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in license_scan.scan(docs_frame(spark, rows)).collect()}
    base = {"gpl", "apache"}
    for d, (label, kind) in want.items():
        if kind == "scattered":
            assert label not in got[d], (label, kind)
        else:
            assert label in got[d], (label, kind)
            # a shorter notice may stand inside a longer one, no other
            assert got[d] - base <= {x for x, t in license_scan.TEMPLATES if t.rstrip(".").lower()[:40] in dict(rows)[d].lower() or x == label or x in ("gpl-short", "apache-short", "bsd-text", "gpl-notice")}, (label, kind, got[d])
    assert all(not got[d] for d, _ in rows if d not in want and d < 5000)
    assert "cc-by-nc-short" in got[5000] and "isc-text" in got[5001]
    part = {r.doc_id: set(r.labels.split(",")) - {""} for r in license_scan.scan(docs_frame(spark, rows), part=7).collect()}
    assert part == got


def test_license_grams_of_no_template_stay_in_python(spark, monkeypatch):
    """What leaves the tasks grows with the matches, not with the words."""
    out, plain = spark.sparkContext.accumulator(0), license_scan.frugal

    def counted(run):
        def wrapped(batches):
            for b in run(batches):
                out.add(len(b))
                yield b

        return plain(wrapped)

    monkeypatch.setattr(license_scan, "frugal", counted)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(500))) for i in range(40)] + [(40, "a b " + license_scan.TEMPLATES[0][1] + " c d")]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_frame(spark, rows)).collect()}
    assert len(got) == 41 and "mit-text" in got[40]["labels"] and not any(got[i]["labels"] for i in range(40))
    assert out.value < 1000  # some 20,000 with all k-grams


def test_registered_queries_match_brute_force(spark):
    """op8, op9 and op10 as registered, over the whole table, against plain loops."""
    docs = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    prints = {}
    for d, t in docs.items():
        w = blank_words(lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    group = {d: d for d in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_tiles(spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", group[d]) for d in docs}

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    pieces = queries.op9_best_fit_packing(spark, SF).toPandas()
    for d, own in pieces.groupby("doc_id"):
        ids, at = [*t.encode(docs[d] or "", add_special_tokens=False).ids, 1], 0
        for r in own.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    assert set(pieces.doc_id) == set(docs)
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert pieces.length.sum() / (2048 * pieces.sequence_id.nunique()) > 0.97

    found = {r.doc_id: r for r in queries.op10_license_diagonals(spark, SF).collect()}
    assert set(found) == set(docs)
    for d, text in docs.items():
        w, places, labels = alnum_words(text), [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        r = found[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_language_edges(spark):
    texts = {"aa": "banana bandana cabana " * 30, "bb": "zyxo wuvo tuvwo " * 30}
    rows = [(i, texts["aa" if i % 2 else "bb"]) for i in range(10)] + [(20, None), (21, ""), (22, "123 !!"), (23, "cabana bandana banana " * 900), (23, "cabana bandana banana " * 900), (None, "x")]
    df = docs_frame(spark, rows, ["aa" if i % 2 else "bb" for i in range(10)] + [None] * 6)
    out = zstd_langid.identify(df, zstd_langid.fit(df))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) - 1 and out.columns[:-3] == df.columns
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") and not got[i].rejected for i in range(10))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (20, 21, 22))
    assert got[23].lang_pred == "aa"
    assert {r.lang_pred for r in zstd_langid.identify(df, {}).collect()} == {"und"}
    with pytest.raises(ValueError):
        zstd_langid.fit(df, max_languages=1)
    named = df.withColumns({"score": F.lit(7), "rejected": F.lit("x")})
    with pytest.raises(ValueError):
        zstd_langid.identify(named, {})
    told = zstd_langid.identify(named, zstd_langid.fit(df), names=("l", "s", "r")).first()
    assert (told.score, told.rejected, told.l in ("aa", "bb", "und")) == (7, "x", True)
    # whole texts: what tells the languages apart may stand at the end
    late = {"aa": "same words here " * 600 + texts["aa"], "bb": "same words here " * 600 + texts["bb"]}
    df = docs_frame(spark, [(0, late["aa"]), (1, late["bb"]), (2, "banana bandana cabana"), (3, "zyxo wuvo tuvwo")], ["aa", "bb", None, None])
    assert [r.lang_pred for r in zstd_langid.identify(df, zstd_langid.fit(df)).orderBy("doc_id").collect()][2:] == ["aa", "bb"]


def test_language_held_out_accuracy(spark):
    out = queries.op5_zstd_language(spark, "/root/testdata/sf0.01").join(queries.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out & out.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert out.held_out.tolist() == [zlib.crc32(str(d).encode()) % 4 == 2 for d in out.doc_id]


def brute_nearest(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 50 == 0:
            s = sorted((-float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)).__round__(12), j) for j, v in good if j != i)
            out[i] = [j for _, j in s[:k]]
    return out


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] + [1.0] * 15), (None, rows[0][1]), (2200, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = ann.usable(df)
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_nearest(rows32)
    exact = ann.search(vectors, vectors.filter("id % 50 = 0"), parts=4, probes=4, block=64).toPandas()
    got = {q: g.sort_values("rank").vec_id.tolist() for q, g in exact.groupby("query_id")}
    assert got == want
    assert (exact.groupby("query_id").score.apply(lambda s: (np.diff(s) <= 0).all())).all()
    few = ann.search(vectors.filter("id < 3"), vectors.filter("id = 0")).collect()
    assert len(few) == 2
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_ann_probes_follow_the_data(spark):
    """Few probes where vectors cluster, with the recall that is asked for."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(60, 24))
    x = centers[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "id long, vec array<double>").withColumn("part", F.lit(9)).withColumn("score", F.lit(0.5))
    w, _, length, probes = ann.fit(frame, parts=32)
    assert w.shape == (24, 32) and length == 24 and probes <= 8
    got = ann.search(frame, frame.filter("id % 50 = 0"), parts=32, block=100).toPandas().groupby("query_id").vec_id.agg(set)
    want = brute_nearest(rows)
    assert sum(len(set(v) & got[q]) for q, v in want.items()) / sum(map(len, want.values())) >= 0.95
    assert ann.fit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 24)))], "id long, vec array<double>"), parts=32)[3] > 8


def test_ann_repeated_queries(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, vec array<double>")
    ask = lambda *q: sorted(map(tuple, ann.search(frame(rows), frame(list(q)), k=5, probes=16).collect()))
    once, other = ask(rows[0]), ask((0, rows[1][1]))
    assert len(once) == len({r[2] for r in once}) == 5
    assert ask(*[rows[0]] * 6) == once
    assert ask(rows[0], (0, rows[1][1]), rows[0]) == sorted(once + other)


def test_ann_recall_on_tables(spark):
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = brute_nearest([(i, v) for i, v in zip(e.vec_id, e.embedding)])
    got = queries.op1_learned_partitions(spark, sf).toPandas().groupby("query_id").vec_id.agg(set)
    hits = sum(len(set(v) & got.get(q, set())) for q, v in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_urls(spark):
    urls = ["https://A.Example.NET/en/x?y#z", "http://b.net/", "http://b.net", "x://example.com/de/1", "http://org/fr/", "http://notorg/fr/", None, "nothing", "", "a://", "http://u:p@h.co.uk:80/p\nq", "http://h2.co.uk?x=/fr/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, "http://x.net/")], "page_id long, url string")
    marks = spark.createDataFrame([(10, 1), (10, 1), (11, None), (None, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_reputation.judge(pages, marks).collect()}
    assert url_reputation.judge(pages, marks).count() == len(urls) + 1
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[1].rule, got[1].verdict) == ("net/", "block") and got[2].rule is None
    assert got[3].rule == "example.com/de/" and got[4].rule == "org/fr/" and got[5].rule is None
    assert all((got[i].host, got[i].path) == ("", "") for i in (6, 7, 8, 9))
    assert (got[10].host, got[10].path) == ("u:p@h.co.uk:80", "/p\nq") and got[11].path == ""
    assert got[10].bad_mean > got[11].bad_mean
    none = url_reputation.judge(pages, marks.limit(0)).collect()
    assert all(r.verdict == "allow" for r in none if r.rule is None)
    assert url_reputation.judge(pages.limit(0), marks).count() == 0


def test_bad_hosts_are_blocked_and_no_others(spark):
    rng = np.random.default_rng(8)
    hosts = [f"h{i}.site{i % 7}.{'co.uk' if i % 3 else 'com'}" for i in range(40)]
    bad = {"h3.site3.co.uk", "h11.site4.co.uk", "h30.site2.com"}
    hosts[3], hosts[11], hosts[30] = sorted(bad, key=["h3.site3.co.uk", "h11.site4.co.uk", "h30.site2.com"].index)
    rows, marks = [], []
    for h in hosts:
        for _ in range(60):
            rows.append((len(rows), f"http://{h}/x", "html", "m"))
            if rng.random() < 0.7:
                marks.append((rows[-1][0], int(rng.random() < (0.7 if h in bad else 0.05))))
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, mean string")
    labels = spark.createDataFrame(marks, "page_id long, bad int")
    got = url_reputation.judge(pages, labels, rules=()).collect()
    assert {r.host for r in got if r.verdict == "block"} == bad and len(got) == len(rows)


def test_suffixes(spark):
    names = ["a.b.com.tr", "x.github.io", "github.io", "192.168.0.1", "[::1]", "a.b.example.com", "b.co.uk", "deep.b.co.uk", "localhost", "", "www.ck", "a.b.ck"]
    df = spark.createDataFrame([(n,) for n in names], "host string")
    domain, suffix = url_reputation.domain_suffix(url_reputation.host_name(F.col("host")))
    got = {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()}
    want = {"a.b.com.tr": ("b.com.tr", "com.tr"), "x.github.io": ("x.github.io", "github.io"), "192.168.0.1": ("192.168.0.1", "address"), "[::1]": ("[::1]", "address"), "a.b.example.com": ("example.com", "com"), "deep.b.co.uk": ("b.co.uk", "co.uk"), "localhost": ("localhost", "localhost")}
    assert {n: got[n] for n in want} == want
    rules = spark.createDataFrame([("com",), ("*.ck",), ("!www.ck",), ("co.uk",), ("uk",), (None,), ("com.tr",)], "rule string")
    for bound in (100_000, 1):
        got = {r.host: (r.domain, r.suffix) for r in url_reputation.listed_suffixes(df, rules, bound).collect()}
        want = {"a.b.com.tr": ("b.com.tr", "com.tr"), "192.168.0.1": ("192.168.0.1", "address"), "deep.b.co.uk": ("b.co.uk", "co.uk"), "www.ck": ("www.ck", "ck"), "a.b.ck": ("a.b.ck", "b.ck"), "localhost": ("localhost", "localhost")}
        assert {n: got[n] for n in want} == want
    pages = spark.createDataFrame([(1, "http://a.b.com.tr/")], "page_id long, url string")
    assert url_reputation.judge(pages, spark.createDataFrame([], "page_id long, bad int"), suffixes=rules).first().verdict == "allow"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(queries.SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    key = [got.columns[0]]
    pd.testing.assert_frame_equal(got.sort_values(key)[sorted(got)].reset_index(drop=True), want.sort_values(key)[sorted(want)].reset_index(drop=True), check_dtype=False)


def test_word_ids_are_the_tokenizers(spark):
    rng = np.random.default_rng(4)
    words = packing.WordTokenizer(queries.tokenizer_path())
    letters = np.array(list("etaoinshrdlucmfwéàüßÉſñŋĿİ'.,!9́"))
    own = {"".join(rng.choice(letters, int(n))) for n in rng.integers(1, 12, 4000)} | {"don't", "Hello,", "éa", "İ", "", "..."}
    words._learn(set(own))
    for w in own:
        assert np.frombuffer(words.known[w], "<u4").tolist() == words.tokenizer.encode(w, add_special_tokens=False).ids, w

"""The operators against brute force, round trips and held-out labels, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import queries as llm_queries
from tidemark.llm import decontaminate, packing, quality, simhash, suffix_tree, token_counts, toxicity, url_filter, warc
from tidemark.llm.common import Kept

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("row", T.StringType()), T.StructField("m", T.LongType()), T.StructField("h", T.LongType())])
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "One two THREE four"), (4, "One two THREE four"), (5, "one two three four"), (6, "é <|endoftext|> 中文 \x1c x"), (None, "one two three four"), (7, "a b " * 9000), (8, "word")]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, None if (i or 0) % 2 else "s", "x", 1, 2) for i, t in rows], DOCS)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def held(i, n, k):
    return (zlib.crc32(str(i).encode()) if i is not None else 0) % n == k


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = sorted(((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in ODD), key=repr)
    assert got(token_counts.token_counts(docs(spark), path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(docs(spark).limit(0), path).count() == 0
    count, rng = token_counts.TokenCounter(path).count, random.Random(5)
    parts = [" ", "  ", "\n", "a", "The", "'ll", "É", "12", "½", "!?", "<|endoftext|>", "\x1c", " ", " ", "中", "😀", "́", "\r\n", "ΑΣ"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert count(s) == len(lib.encode(s, add_special_tokens=False).ids), s


def test_long_pieces_are_not_kept():
    counter = token_counts.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("x" * 100_000, "ab1" * 60_000, " ".join("qwertz" * 40 + str(i) for i in range(500)), "short words of a text"):
        assert counter.count(text) == len(lib.encode(text, add_special_tokens=False).ids)
    assert max(map(len, counter.words)) <= 128 and max(map(len, counter.pieces)) <= 128
    kept = Kept(lambda k: k.upper(), room=10_000)
    assert all(kept[str(i)] == str(i) for i in range(1000)) and len(kept) < 60


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    out = packing.pack(docs(spark), path, capacity=64).collect()
    want = []
    for i, t in ODD:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) == -(-sum(r["length"] for r in out) // 64)  # as few as can be, here
    assert packing.pack(docs(spark).limit(0), path).count() == 0


def best_possible(sizes, capacity):
    """The fewest bins, by trying all places for each piece in turn."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins)}.values():
            if bins[b] + sizes[i] <= capacity:
                bins[b] += sizes[i]
                go(i + 1, bins)
                bins[b] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.randint(6, 20)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        plan = packing.Plan(capacity)
        left = packing.reduce_dominated(dict(Counter(sizes)), plan)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert plan.bins + (best_possible(rest, capacity) if rest else 0) == best_possible(sizes, capacity), (sizes, capacity)


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_simhash(spark):
    small = [(i, t if len(t or "") < 9999 else t[:400]) for i, t in ODD]
    rng = random.Random(1)
    base = [[f"w{rng.randrange(50)}" for _ in range(300)] for _ in range(6)]
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(300)] = "new"
        small.append((100 + i, " ".join(w)))
    out = simhash.near_duplicates(docs(spark, small))
    assert got(out, "doc_id", "fingerprint", "component_id") == brute_components(small)
    kept = simhash.one_of_each_group(docs(spark, small))
    assert kept.columns == DOCS.names and {r["doc_id"] for r in kept.collect()} == {c for *_, c in brute_components(small)}
    assert simhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_rows_without_id_bridge_groups(spark):
    """Fingerprints that only rows without id have link those of others, and get their component's id."""
    texts = {}
    rng = random.Random(6)
    base = [f"w{rng.randrange(30)}" for _ in range(120)]
    while len(texts) < 400:
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(120)] = f"n{rng.randrange(9)}"
        texts.setdefault(brute_fingerprint(" ".join(w)), " ".join(w))
    rows = [(None if i % 3 else 1000 - i, t) for i, t in enumerate(texts.values())] + [(None, "alone in here")]
    assert got(simhash.near_duplicates(docs(spark, rows)), "doc_id", "fingerprint", "component_id") == brute_components(rows)


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_similar_documents(spark):
    """Texts of a similarity of 0.85 or more are linked, those under 0.65 are not; in between is chance."""
    rng, rows = random.Random(12), list(ODD)
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(150, 400))]
        for k in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 40])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((100 + 10 * g + k, " ".join(w)))
    out = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs(spark, rows)).collect()}
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    near = far = found = 0
    for i in sets:
        for j in sets:
            if i < j and (sets[i] or sets[j]):
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                near += s >= 0.85
                found += s >= 0.85 and out[i] == out[j]
                far += s < 0.65 and out[i] == out[j]
    assert near > 30 and found >= 0.9 * near and far == 0
    kept = simhash.one_of_each_similar(docs(spark, rows))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == DOCS.names and ids == {c for d, c in out.items()} and simhash.similar_documents(docs(spark).limit(0)).count() == 0


def test_simhash_large_trie(spark):
    """A trie that is cut into chunks links like one that is not."""
    rng = random.Random(4)
    fps = set()
    while len(fps) < 300:
        f = 0x123456789ABCDEF0
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f - (1 << 64) if f >> 63 else f)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long")).collect()
    label = list(range(300))

    def joined(pairs):
        lab = list(label)

        def root(x):
            while lab[x] != x:
                x = lab[x]
            return x

        for a, b in pairs:
            lab[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in label]

    near = [(i, j) for i in range(300) for j in range(i) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3]
    assert joined([(e["a"], e["b"]) for e in edges]) == joined(near)


def test_decontaminate(spark):
    rng = random.Random(7)
    vocabulary = [f"t{i}" for i in range(6)]
    items = [(f"b{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 16)))) for i in range(12)] + [(None, "t1"), ("z", None), ("short", "One, TWO")]
    rows = [*ODD, *[(50 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(40)], *[(200 + i, f"x {t} y") for i, (_, t) in enumerate(items) if t]]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = []
    for i, t in rows:
        w, hit, found = decontaminate.words((t or "").encode()), set(), set()
        for name, text in items:
            b = decontaminate.words((text or "").encode())
            n = min(10, len(b))
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b and name else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(name)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.contamination(docs(spark, rows), bench), *columns) == sorted(want, key=repr)
    old, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 60  # several blocks of the test set
    try:
        assert got(decontaminate.contamination(docs(spark, rows), bench), *columns) == sorted(want, key=repr)
    finally:
        decontaminate.BLOCK_BYTES = old
    bad = {w[0] for w in want if w[-1]}
    assert {r["doc_id"] for r in decontaminate.clean(docs(spark, rows), bench).collect()} == {i for i, _ in rows} - bad
    assert got(decontaminate.contamination(docs(spark), bench.limit(0)), "n_hit") == [(0,)] * len(ODD)


def test_proximity(spark):
    bench = spark.createDataFrame([("a", "red fox jumps")], "item_id string, text string")
    rows = [(1, "the red fox jumps"), (2, "red old fox now jumps"), (3, "red a b fox jumps"), (4, "fox red jumps"), (5, "red red x fox fox jumps")]
    out = decontaminate.contamination(docs(spark, rows), bench, slop=1)
    assert got(out, "doc_id", "n_hit") == [(1, 3), (2, 5), (3, 0), (4, 0), (5, 5)]


def test_language_model(spark):
    rows = [*ODD, *[(100 + i, "the cat sat on the mat and " * 3 + f"w{i} der hund und die katze") for i in range(60)]]
    out = {}
    for r in suffix_tree.score(docs(spark, rows)).collect():
        out.setdefault(r["doc_id"], []).append(r)
    counts = Counter()
    for i, t in rows:
        if not held(i, 5, 1):
            counts.update([*(t or "").encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), "end"]
        r = out[i][0]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i, 5, 1), len(w), sum(counts[x] > 0 for x in w), n) and r["base_score"] == pytest.approx(base) and r["score"] < 0
    late = [r[0] for i, r in out.items() if i and i >= 100 and r[0]["held_out"]]
    assert late and all(r["score"] > r["base_score"] for r in late)
    assert sum(map(len, out.values())) == len(rows) and suffix_tree.score(docs(spark).limit(0)).count() == 0


def test_suffix_tree_is_a_distribution():
    """After any context the probabilities of all symbols add up to one."""
    rng = np.random.default_rng(0)
    seq = rng.integers(3, 9, 4000)
    seq[1::2] = (seq[0::2] + 1 - 3) % 6 + 3  # every other symbol follows from the one before
    levels, counts = [], []
    sym = np.concatenate([[suffix_tree.START], seq, [suffix_tree.END]])
    for d in range(3):
        ctx = suffix_tree.numbers(sym, levels)[-1]
        ok = (ctx >= 0) & (sym != suffix_tree.START)
        code, n = np.unique(ctx[ok] << suffix_tree.BITS | sym[ok], return_counts=True)
        counts.append((code, n))
        if d < 2:
            grow = code[(n > 20) & (code & (1 << suffix_tree.BITS) - 1 != suffix_tree.END)]
            levels.append(suffix_tree.Level(np.append(grow, suffix_tree.START) if d == 0 else grow))
    tree = suffix_tree.SuffixTree(10, counts, levels)
    assert len(tree.parent) > 3
    for before in ([], [4], [5, 6], [3, 4, 5], [9]):
        total = sum(10 ** tree.log(np.array([suffix_tree.START, *before, s]))[-1] for s in range(1, 10))
        assert total == pytest.approx(1)
    assert tree.log(sym).sum() > tree.root[sym[1:]].sum()


def brute_segments(scores):
    """Ruzzo and Tompa's definition by recursion: the best segment (shortest, then first), then the same left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    i, n = -best[2], -best[1]
    left, right = brute_segments(scores[:i]), brute_segments(scores[i + n :])
    return [*left, (best[0], i, i + n), *[(v, a + i + n, b + i + n) for v, a, b in right]]


def test_segments():
    rng = random.Random(9)
    for _ in range(300):
        s = [rng.uniform(-1, 0.8) for _ in range(rng.randint(0, 14))]
        ours = toxicity.segments(np.array(s))
        assert [x[1:] for x in ours] == [x[1:] for x in brute_segments(s)] and np.allclose([x[0] for x in ours], [x[0] for x in brute_segments(s)])


def test_toxicity(spark):
    rng = random.Random(11)
    rows, labels = list(ODD), [(None, 1, 1), (1, 1, None)]
    for i in range(100, 700):
        w = [f"w{rng.randrange(400)}" for _ in range(120)]
        bad = rng.random() < 0.2
        if bad:
            at = rng.randrange(100)
            w[at : at + 3] = [rng.choice(["vileness", "scoundrel", "wretched"]) for _ in range(3)]
        rows.append((i, " ".join(w)))
        labels += [(i, 1, int(bad))] * (1 + i % 2)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows), lab)
    out = toxicity.score(docs(spark, rows), model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"], 3, 1) for r in out)
    truth = {i: y for i, _, y in labels if y is not None}
    wrong = sum(r["predicted"] != truth[r["doc_id"]] for r in out if r["doc_id"] in truth and r["held_out"])
    assert wrong <= 4
    empty = toxicity.fit(docs(spark).limit(0), lab.limit(0))
    assert toxicity.score(docs(spark), empty).count() == len(ODD)


def test_quality(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [*ODD, (20, words), (21, "a b c d " * 20), (22, words + "\nx # $\nx # $\n\n"), (None, words)]
    out = quality.quality(docs(spark, rows))
    assert {r["doc_id"] for r in out.collect() if not r["base_failed"]} == {20, 22, None}
    r = out.filter("doc_id = 22").first()
    assert (r["n_words"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (66, 4, 1, 6)
    assert out.filter("doc_id = 7").first()["n_repeat_words"] == 18000 and quality.quality(docs(spark).limit(0)).count() == 0
    assert quality.keep(docs(spark, rows), most_failed=1.0).columns == DOCS.names and {r["doc_id"] for r in quality.keep(docs(spark, rows), most_failed=1.0).collect()} == {20, 22, None}
    clash = docs(spark, rows).withColumnsRenamed({"row": "_rejected", "m": "a.b", "h": "base_failed"})
    assert quality.keep(clash).columns == clash.columns and quality.keep(clash, most_failed=1.0).count() == 3 and quality.keep(clash.limit(0)).count() == 0
    many = docs(spark).select("doc_id", "text", "row").withColumn("source", F.lit("bad")).unionByName(docs(spark, [(90 + i, words) for i in range(40)]).select("doc_id", "text", "row").withColumn("source", F.lit("good"))).unionByName(
        docs(spark, [(99, words)]).select("doc_id", "text", "row").withColumn("source", F.lit("bad")))
    assert not quality.quality(many).filter("doc_id = 99 and base_failed").count() and {r["doc_id"] for r in quality.keep(many).collect()} >= {90, 120}


def test_url_filter(spark, monkeypatch):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("example.com", "/en/x/", "allow"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "", "allow"), ("net", "/es/", "allow")]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/x/1?q", "http://b.example.com/en/x#f", "http://b.example.com/en/x/", "http://badexample.com/en/", "http://example.com", "http://x.net/es/", "http://a.net?x=://y/", "http://c.a.net/es/1", "com://net/es/", "http://net/es/1", "http://..com/", "http://é.com/ü"] * 2
    page = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)] + [(None, "http://q.com/", None)], "page_id long, url string, html string")
    out = url_filter.judge(page, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        fit = [(h.count("."), len(p), v, h + p) for h, p, v in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        best = max(fit, default=None)
        assert (r["rule"], r["verdict"]) == ((best[3], best[2]) if best else (None, "allow")), r
    by = {r["page_id"]: (r["host"], r["path"]) for r in out}
    assert by[4] == ("www.example.com", "/en/1") and by[0] == by[1] == by[2] == ("", "") and by[9] == ("example.com", "") and by[11] == ("a.net", "")
    assert url_filter.judge(page, spark.createDataFrame([], "host string, path string, verdict string")).filter("rule is null").count() == len(urls) + 1
    monkeypatch.setattr(url_filter, "SWEEP_ROWS", 3)  # hosts are cut over several sweeps
    cut = url_filter.judge(page, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted(cut, key=repr) == sorted(out, key=repr)
    empty = url_filter.judge(page.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert empty.collect() == []


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://a/\r\nWARC-Type: x", "é" * 50_000), (1, None, "é" * 50_000), (5, "u", None), (4, "u", ""), (9, "v", "<p>\r\n\r\n</p>"), (9, "v", "<p>\r\n\r\n</p>"), (12, "w", "x")], "page_id long, url string, html string")
    path = warc.archive(pages, f"file://{tmp_path}/w")
    bare = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    first = {"é" * 50_000: 1, "": 4, "<p>\r\n\r\n</p>": 9, "x": 12}
    want = [(i, len((h or "").encode()), bare(h or ""), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in pages.collect()]
    assert got(warc.contents(spark, path), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    raw = spark.read.format("warc").load(path)
    plan = raw.filter("record_type = 'revisit' and record_id = '<urn:page:3>'")
    assert plan.count() == 1 and "Filter" not in plan._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert {bytes(r["payload"]).decode() for r in raw.filter("record_type = 'response'").collect()} == set(first)
    # an archive of others: no list, no size fields, plain and compressed
    import gzip

    rows = [{"record_type": "response", "record_id": f"<r{i}>", "payload": b"x" * i * 9999, "payload_digest": warc.digest(b"x" * i * 9999)} for i in range(12)]
    (tmp_path / "o").mkdir()
    (tmp_path / "o/a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(r)) for r in rows))
    (tmp_path / "o/b.warc").write_bytes(b"".join(warc.record(r) for r in rows))
    other = spark.read.format("warc").option("verify", "true").load(f"file://{tmp_path}/o")
    assert Counter((r["record_id"], len(r["payload"])) for r in other.collect()) == Counter({(f"<r{i}>", i * 9999): 2 for i in range(12)})
    warc.archive(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.contents(spark, f"file://{tmp_path}/none").count() == 0


def test_registered_queries_without_sql(spark):
    """The thin queries over the whole smallest tables, against the libraries and plain Python."""
    from test_line_dedup import brute
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    run = {name: [r.asDict() for r in llm_queries.queries()[name](spark, sf).collect()] for name in ("op1_lm_score", "op3_line_dedup", "op5_toxicity", "op6_simhash", "op9_packing", "op10_token_counts")}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run["op10_token_counts"]} == {i: (len((t or "").encode()), counts[i], counts[i] > 512) for i, t in rows}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n_ids = {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    total = Counter()
    for r in run["op9_packing"]:
        total[r["doc_id"]] += r["length"]
    assert total == n_ids
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run["op6_simhash"]), key=repr) == brute_components(rows)
    gone = brute(rows)
    for r in run["op3_line_dedup"]:
        text = dict(rows)[r["doc_id"]]
        lines = text.split("\n") if text is not None else []
        mine = {k: near for (d, k), near in gone.items() if d == r["doc_id"]}
        left = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in mine)
        near = sum(mine.values())
        want = (len(lines), len(mine) - near, near, bool(mine) and not left.encode().split(), left if left is None else hashlib.sha256(left.encode()).hexdigest())
        assert (r["n_lines"], r["n_equal"], r["n_near"], r["emptied"], r["kept_sha256"]) == want, r["doc_id"]
    words = {i: [*(t or "").encode().lower().split(), "end"] for i, t in rows}
    c = Counter(w for i, ws in words.items() if not held(i, 5, 1) for w in ws)
    n, v = sum(c.values()), len(c)
    for r in run["op1_lm_score"]:
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"], 5, 1), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) and r["score"] < 0
    assert len(run["op5_toxicity"]) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"], 3, 1) for r in run["op5_toxicity"])


def test_priors_and_extremes():
    """Rates shrunk by hand; lambda as the root of its equation; K as its estimate."""
    seen, by = toxicity.learn({b"abcdef": (6.0, 2.0)}, {b"abcd": (6.0, 2.0), b"abcde": (6.0, 2.0)}, 0.1)
    four = (6 + 12 * 0.1) / 20
    five = (6 + 12 * four) / 20
    word = (6 + 4 * five) / 12
    odds = lambda p: math.log(p / (1 - p)) - math.log(0.1 / 0.9) - toxicity.DRIFT
    assert by == pytest.approx({b"abcd": odds(four), b"abcde": odds(five)}) and seen == pytest.approx({b"abcdef": odds(word)})
    x = toxicity.Extremes({-2.0: 90, 1.0: 9, 3.0: 1}, [(100, 2.0), (50, 1.0), (0, 5.0)])
    assert 0.9 * math.exp(-2 * x.rate) + 0.09 * math.exp(x.rate) + 0.01 * math.exp(3 * x.rate) == pytest.approx(1) and x.rate > 0.01
    assert x.k == pytest.approx(2 / (100 * math.exp(-2 * x.rate) + 50 * math.exp(-x.rate)))
    assert x.log_e(4.0, 70) == pytest.approx(math.log(x.k * 70 * math.exp(-4 * x.rate)))
    a, b = toxicity.logistic(np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 0, 1, 0, 1, 1]))
    p = 1 / (1 + np.exp(-(a + b * np.arange(6))))
    assert b > 0 and (p - [0, 0, 1, 0, 1, 1]).sum() == pytest.approx(0, abs=0.01)

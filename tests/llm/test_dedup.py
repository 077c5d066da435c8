"""Near duplicates, repeated passages and recurring lines against brute force."""

import hashlib
import re
from collections import Counter

import xxhash

from docloom.llm.line_dedup import line_dedup
from docloom.llm.simhash import BITS, RADIUS, _link_buckets, covering_masks, deduplicate, hex_fingerprint, near_duplicates
from docloom.llm.substring_dedup import remove_repeats

WORDS = re.compile("[^\\x20\\x09-\\x0D]+")


def simhash_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def chained(prints):
    """Smallest id reachable from each (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if bin(a ^ b).count("1") <= RADIUS:
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(prints):
        r = root(i)
        low[r] = k if low.get(r) is None else low[r] if k is None else min(low[r], k)
    return [low[root(i)] for i in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    import itertools
    import random

    masks = [m & (1 << BITS) - 1 for m in covering_masks(0)]
    rng = random.Random(1)
    for bits in itertools.chain(itertools.combinations(range(12), 3), (rng.sample(range(64), 3) for _ in range(5000))):
        flip = sum(1 << b for b in bits)
        assert any(m & flip == 0 for m in masks)


def test_near_duplicates_equal_brute_force(docs, rows):
    got = near_duplicates(docs).select("doc_id", hex_fingerprint("fp").alias("fp"), "component_id").collect()
    prints = [(r[0], simhash_of(r[1])) for r in rows]
    want = Counter((i, f"{f:016x}", c) for (i, f), c in zip(prints, chained(prints), strict=True))
    assert Counter(map(tuple, got)) == want


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    """Over 512 fingerprints that agree on a mask's bits: chains must still be found."""
    import random

    import docloom.llm.simhash as module

    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(1500)}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(prints))]
    table = spark.createDataFrame(rows, "doc_id long, fp long").repartition(4)
    monkeypatch.setattr(module, "fingerprints", lambda *a: table)
    got = {r.doc_id: r.component_id for r in near_duplicates(table).collect()}
    want = chained([(i, f & (1 << 64) - 1) for i, f in rows])
    assert got == {i: c for (i, _), c in zip(rows, want, strict=True)}


def test_bucket_rows_pass_on_in_any_batch_size():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    bucket = np.sort(np.r_[np.zeros(700), np.ones(3), np.full(600, 2), np.full(2, 3)]).astype(np.int64)
    cols = [np.zeros(len(bucket), np.int64), bucket, rng.integers(0, 1 << 62, len(bucket)), np.arange(len(bucket))]
    for size in (1, 7, 513, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], ["mask", "bucket", "fp", "rep"]) for i in range(0, len(bucket), size)]
        heavy = [r for b in _link_buckets(False)(iter(batches)) for r in b.column("rep").to_pylist() if r is not None and b.column("a")[0].as_py() is None]
        assert sorted(heavy) == [*range(700), *range(703, 1303)]


def test_one_row_of_each_group_stays(docs, rows):
    out = deduplicate(docs)
    assert out.columns == docs.columns
    texts = Counter(r.text for r in out.collect())
    assert texts[rows[3][1]] == 1 and texts[rows[4][1]] == 1
    assert any(t and t.startswith("this row has no id") for t in texts)
    assert {r.doc_id for r in out.collect()}.isdisjoint({40, 41, 42})


def brute_force_repeats(rows, size=13):
    """Rows in any number an id; None is larger than any id."""
    order = lambda k: (k is None, k or 0)
    first = {}
    words = [(k, WORDS.findall(t or "")) for k, t in rows]
    for k, w in words:
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            first[g] = min(first.get(g, order(k)), order(k))
    out = Counter()
    for k, w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < order(k):
                gone |= set(range(i, i + size))
        out[k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def test_repeats_equal_brute_force(docs, rows):
    assert Counter(tuple(r) for r in remove_repeats(docs).collect()) == brute_force_repeats([(r[0], r[1]) for r in rows])


def test_rows_of_one_id_keep_their_own_words(spark):
    said = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    a, b, c = said("a", 30), said("b", 60), said("c", 13)
    top = (1 << 63) - 1
    rows = [(None, a), (None, b + " " + a), (7, b), (7, a + " " + c), (7, "x"), (7, c + " " + b), (top, c), (None, c), (9, said("d", 12)), (3, said("d", 12)), (7, b), (None, None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(tuple(r) for r in got.collect()) == brute_force_repeats(rows)


def test_line_dedup_equals_brute_force(spark):
    nav, foot = "Home | About", "All rights reserved"
    html = [f"<p>{nav}</p><p>Story {i} of the day</p><b> {foot}\t </b>" for i in range(8)]
    pages = [(i, f"https://Site.example/p{i}", h) for i, h in enumerate(html)]
    pages += [(20, "http://other.example/x", html[0]), (21, None, html[1]), (22, "no url", None), (23, "http://other.example", ""), (20, "http://other.example/x", html[0])]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in line_dedup(df).collect()}
    assert got[3].host == "site.example" and got[3].kept_text == "Story 3 of the day" and got[3].n_removed == 2
    assert got[20].n_removed == 0 and got[21].kept_text.split("\n") == [nav, "Story 1 of the day", foot]
    assert got[22].n_lines == 0 and got[23].kept_text == ""
    assert line_dedup(df).count() == len(pages) and line_dedup(df.limit(0)).count() == 0
    joined = line_dedup(df, broadcast_lines=0)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, line_dedup(df).collect()), key=str)


def test_line_at_the_ratio_stays_and_long_pages_are_whole(spark):
    pages = [(i, "http://h/x", f"<p>{'edge' if i < 3 else i}</p><p>{'over' if i < 4 else -i}</p>" + "<p>w</p>" * (50_000 if i == 9 else 0)) for i in range(10)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in line_dedup(df).collect()}
    assert got[0].kept_text == "edge" and got[3].kept_text == "3" and got[9].n_lines == 50_002 and got[9].n_removed == 0


def test_empty_tables(none):
    assert near_duplicates(none).count() == 0
    assert deduplicate(none).count() == 0
    assert remove_repeats(none).count() == 0


def test_digest_matches_text(docs):
    from pyspark.sql import functions as F

    r = remove_repeats(docs).select("kept_text", F.sha2("kept_text", 256).alias("d")).first()
    assert r.d == hashlib.sha256(r.kept_text.encode()).hexdigest()


def test_nodes_are_fingerprints_not_ids(spark, monkeypatch):
    import docloom.llm.simhash as module

    rows = [(1, 0b0), (None, 0b111), (2, 0b111111), (7, 1 << 40 | 0xFFFF << 20), (7, 0xFFFFFFF << 30), (None, 0xFFFFFF << 8)]
    table = spark.createDataFrame(rows, "doc_id long, fp long")
    with monkeypatch.context() as m:
        m.setattr(module, "fingerprints", lambda *a: table)
        got = sorted(((r.doc_id or 0, r.fp), r.component_id) for r in near_duplicates(table).collect())
    want = {0b0: 1, 0b111: 1, 0b111111: 1, 1 << 40 | 0xFFFF << 20: 7, 0xFFFFFFF << 30: 7, 0xFFFFFF << 8: None}
    assert got == sorted(((i or 0, f), want[f]) for i, f in rows)
    texts = [" ".join(f"{p}{i}" for i in range(80)) for p in "abc"]
    docs = spark.createDataFrame([(1, texts[0]), (5, texts[0]), (5, texts[1]), (5, texts[2]), (5, texts[2])], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in deduplicate(docs).collect()) == [(1, texts[0]), (5, texts[1]), (5, texts[2])]

"""Rules, classifier, token files, mixing, chats, language model, decontamination and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm.chat_format import format_chats, read_loss, read_turns
from docloom.llm.decontaminate import contained_items, remove_contaminated
from docloom.llm.lm_scoring import OFFSETS, VOCAB, Network, score_documents
from docloom.llm.mixing import mix, mix_texts, permute, permuted, plan_source, shard_counts, targets
from docloom.llm.quality_classifier import BINS, FEATURES, HIGH, LOW, RIDGE, Model, classify, fit_labels, isotonic, keep_good, statistics
from docloom.llm.quality_rules import score_rules
from docloom.llm.shared import words_of
from docloom.llm.token_output import Sequences, read_tokens, write_tokens

from test_dedup import chained, simhash_of

WORDS = re.compile("[^\\x20\\x09-\\x0D]+")


def rule_counts(text):
    w = WORDS.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    hit = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules_equal_brute_force(docs, rows, none):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in score_rules(docs).collect())
    assert got == Counter((r[0], *rule_counts(r[1])) for r in rows)
    assert score_rules(none).count() == 0


def test_boilerplate_lines_deplete_documents(spark):
    menu = " ".join(f"menu{i}" for i in range(60))
    own = [" ".join(f"own{i}x{j}" for j in range(60)) for i in range(30)]
    rows = [(i, f"{menu}\n {menu.upper()} \n{menu}\n{own[i]}" if i < 25 else own[i], "h" if i != 5 else None) for i in range(30)]
    got = {r.doc_id: r for r in score_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].n_boilerplate_words == 180 and got[5].n_boilerplate_words == 0 and got[27].kept
    repeated = [(1, f"{menu}\n{own[0]}", "h")] * 30  # one document, however often its row stands there
    got = score_rules(spark.createDataFrame(repeated, "doc_id long, text string, source string")).collect()
    assert len(got) == 30 and all(r.n_boilerplate_words == 0 and r.kept for r in got)


def test_classifier_on_held_out_rows(spark, sf_dir, none):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([(r.predicted == 1) == (r.doc_id % 3 != 0) for r in held]) > 0.95
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    assert classify(none, labels).count() == 0
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}


def plain_model(texts, labels):
    """The normal equations, the solution and the calibration once more, over all labelled rows at once."""
    marks = {}
    for r in labels:
        if r.doc_id is not None and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            marks[r.doc_id] = max(marks.get(r.doc_id, 0), r.quality)
    ids = sorted(marks)
    stats, y = np.array([statistics(texts[i]) for i in ids]), np.array([float(marks[i]) for i in ids])
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
    model = Model(stats.mean(0), stats.std(0) + 1e-6)
    z = model.features(stats)
    fitted = fold != 1
    penalty = np.diag([RIDGE] * FEATURES + [1e-9])
    model.weights = np.linalg.solve(z[fitted].T @ z[fitted] + penalty, z[fitted].T @ y[fitted])
    bins = np.minimum((model.raw(stats[~fitted]) - LOW) / (HIGH - LOW) * BINS, BINS - 1).astype(int)
    places = sorted(set(bins))
    model.at = LOW + (np.array(places) + 0.5) * (HIGH - LOW) / BINS
    model.value = isotonic(np.array([y[~fitted][bins == b].sum() for b in places]), np.array([float((bins == b).sum()) for b in places]))
    return model


def test_scores_equal_a_fit_in_one_process(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    model = plain_model(texts, labels.collect())
    for r in classify(docs, labels).collect():
        assert r.score == pytest.approx(model.score(statistics(texts[r.doc_id])[None])[0], abs=1e-6)


def test_classifier_on_awkward_rows(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)] + [(None, 1), (7, None), (3, 1), (3, 0)], "doc_id long, quality int")
    got = Counter((r.doc_id, round(r.score, 9)) for r in classify(docs, labels).collect())
    assert sum(got.values()) == len(rows)
    by_text = {}
    for r in docs.select("doc_id", "text").join(classify(docs, labels).where("doc_id <> 4").distinct(), "doc_id").collect():
        assert by_text.setdefault((r.text or "").strip(), r.score) == r.score  # equal texts, equal scores
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and keep_good(none, labels).count() == 0
    texts = Counter(r.text for r in kept.collect())
    assert all(n == sum(r[1] == t for r in rows) for t, n in texts.items())


def test_fit_takes_a_bounded_sample(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    some = [fit_labels(docs.repartition(n), labels, "doc_id", "text", "quality", max_labelled=50).weights for n in (2, 5)]
    assert np.allclose(*some) and np.any(some[0])


def test_isotonic_pools_violators():
    assert isotonic(np.array([1.0, 0, 3]), np.array([1.0, 1, 3])).tolist() == [0.5, 0.5, 1.0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_files_hold_every_document(spark, docs, rows, none, name, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    manifest = write_tokens(docs, path, f"file://{tmp_path}/t", length=64, rows=8)
    got = sorted(read_tokens(manifest).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    start, seen = 0, Counter()
    for r in got:
        assert r.start == start
        start += r.n_tokens
        seen[r.doc_id, r.n_tokens, r.ids_crc32] += 1
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert seen == want
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    real = 0
    for m in manifest.collect():
        s = Sequences(m.path + ".arrow")
        assert all(len(s[i][0]) == 64 for i in range(len(s)))
        real += sum(int(s[i][1].sum()) for i in range(len(s)))
    assert real == start
    first = manifest.orderBy("part").first()
    sequences = Sequences(first.path + ".arrow")
    ids, mask = sequences[0]
    assert ids.base is not None and mask.base is not None and not mask.flags.owndata and len(ids) == len(mask) == 64
    assert sequences.n_tokens() == first.n_tokens and list(sequences[len(sequences) - 1][1]).count(1) == (first.n_tokens - 1) % 64 + 1
    with pytest.raises(IndexError):
        sequences[len(sequences)]
    assert read_tokens(write_tokens(none, path, f"file://{tmp_path}/e")).count() == 0


def test_targets_and_shards():
    assert targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert all(t <= 2 * n for t, n in zip(targets([10, 500, 3, 0]), [10, 500, 3, 0], strict=True))
    counts = shard_counts([1000, 10, 0, 333], 16)
    assert counts.sum(axis=0).tolist() == [1000, 10, 0, 333] and np.ptp(counts.sum(axis=1)) <= 1


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        t = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("x"))
        assert sorted(r.x for r in t.collect()) == list(range(n))
        there = permute(np.arange(n), np.full(n, n), np.full(n, 9))
        assert permute(there, np.full(n, n), np.full(n, 9), back=True).tolist() == list(range(n))


def test_mix_meets_its_targets(docs, rows, none):
    got = mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORDS.findall(r[1] or ""))) for r in rows)
    taken, goal = Counter(), {}
    for r in got:
        n = sum(p.to - p["from"] for p in r.pieces or [])
        assert n <= 2 * r.size and all(0 <= p["from"] < p.to <= r.size for p in r.pieces or [])
        taken[r.source] += n
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)
    again = mix(docs.repartition(5)).collect()
    total = lambda x: Counter((r.doc_id, r.source, sum(p.to - p["from"] for p in r.pieces or [])) for r in x if r.doc_id not in (4, None))
    assert total(got) == total(again)
    assert mix(none).count() == 0


def plain_mix(rows, block, seed, shards, repeat=2):
    """{id: pieces} of rows (id, source, text): slots drawn one after the other over each source's words laid out as a list."""
    by_source, size = {}, lambda r: len(WORDS.findall(r[2] or ""))
    for r in sorted(rows, key=lambda r: (r[0], size(r))):
        by_source.setdefault(r[1], []).extend([(r[0], i) for i in range(size(r))])
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    goal = targets([len(by_source[s]) for s in names])
    plans = [plan_source(i, len(by_source[s]), goal[i], block, repeat, seed) for i, s in enumerate(names)]
    counts, want = shard_counts([p["slots"] for p in plans], shards, seed), {r[0]: [] for r in rows}
    for i, s in enumerate(names):
        words, left, shard_of = by_source[s], round(goal[i]), np.repeat(np.arange(shards), counts[:, i])
        blocks = [words[k : k + block] for k in range(0, len(words), block)]
        for slot in range(plans[i]["slots"]):
            turn, at = divmod(slot, len(blocks))
            order = permute(np.arange(len(blocks)), np.full(len(blocks), len(blocks)), np.full(len(blocks), plans[i]["keys"][turn]))
            assert sorted(order) == list(range(len(blocks)))
            part = blocks[order[at]][:left]
            left -= len(part)
            spans = {}
            for d, w in part:
                spans.setdefault(d, []).append(w)
            for d, ws in spans.items():
                want[d].append((int(shard_of[slot]), slot, ws[0], ws[-1] + 1))
        assert left == 0
    return {d: sorted(x) for d, x in want.items()}


def test_mix_equals_a_plain_draw(docs, rows):
    unique = [(r[0], r[3], r[1]) for r in dict.fromkeys(rows) if r[0] not in (None, 4)]
    got = mix(docs.where("doc_id is not null and doc_id <> 4").distinct(), block=16, seed=3, shards=8).collect()
    assert {r.doc_id: sorted(tuple(p) for p in r.pieces or []) for r in got} == plain_mix(unique, 16, 3, 8)


def test_mixed_texts_hold_the_words_taken(docs, none):
    out = mix_texts(docs)
    assert out.columns == docs.columns
    words = out.select(F.sum(F.size(words_of(F.col("text")))).alias("n"), F.count_if(F.col("n_chars") != F.length("text")).alias("bad")).first()
    taken = sum(p.to - p["from"] for r in mix(docs).collect() for p in r.pieces or [])
    assert words.bad == 0 and abs(words.n - taken) <= 1000 and mix_texts(none).count() == 0


def test_chats_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>", "a\\sb\\c <| <|end|>", "", "\n<|part|>", "\\", "日本 <", "|> x"]
    rows = [(1, i, ["user", "assistant", "assistant", "user"][i % 4], t) for i, t in enumerate(said)]
    rows += [(2, 0, "assistant", None), (3, None, None, "x"), (None, 1, "user", "y"), (4, 1, "a", "z"), (4, 1, "a", "z"), (5, 0, "<|end|>", "\\")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ord int")
    chats = format_chats(df)
    got = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    want = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    assert {r.conv_id: [tuple(x) for x in r.t] for r in got} == want
    assert {r.conv_id: r.l for r in got} == {c: [t for r, t in x if r == "assistant"] for c, x in want.items()}
    assert format_chats(df.limit(0)).count() == 0


def test_long_chats(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(1500)] + [(2, 0, "assistant", "x" * 200_000), (2, 1, "assistant", "<|" * 9)]
    chats = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    got = chats.select("conv_id", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    for r in got:
        want = [x for x in rows if x[0] == r.conv_id]
        assert [tuple(x) for x in r.t] == [x[2:] for x in want] and r.l == [x[3] for x in want if x[2] == "assistant"]


def test_network_gradient_and_normalisation():
    net, rng = Network(), np.random.default_rng(1)
    context = rng.integers(0, VOCAB, (1, len(OFFSETS)))
    logs = net.forward(np.repeat(context, VOCAB, axis=0), np.arange(VOCAB))
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-3)
    context, target = rng.integers(0, 50, (512, len(OFFSETS))), rng.integers(0, 9, 512)
    before = net.forward(context, target).mean()
    for _ in range(30):
        net.train(context, target)
    assert net.forward(context, target).mean() > before + 1


def test_training_step_follows_the_gradient():
    """Running text with edges in it: each parameter's step against the slope of the mean log-probability."""
    import docloom.llm.lm_scoring as lm

    rng, edge = np.random.default_rng(5), lm.EDGE
    ids = np.r_[edge, edge, rng.integers(0, 40, 9), edge, edge, rng.integers(0, VOCAB, 30), edge, edge].astype(np.int32)
    words = [i for i in range(len(ids)) if ids[i] != edge]
    flat = rng.normal(0, 0.3, len(Network().flat())).astype(np.float32)

    def mean(flat):
        p, at = {}, 0
        for name, shape in lm.SHAPES.items():
            p[name] = flat[at : at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))
        total = 0.0
        for i in words:
            h = np.tanh(p["bias"] + sum(p["words"][k][ids[i + o]] for k, o in enumerate(OFFSETS)))
            first, second = divmod(int(ids[i]), lm.DIGIT)
            for x, digit in ((h @ p["high"] + p["high_bias"], first), ((h + p["digit"][first]) @ p["low"] + p["low_bias"], second)):
                total += x[digit] - np.log(np.exp(x).sum())
        return total / len(words)

    net = Network(flat)
    assert net.train_along(ids) == len(words)
    moved, start, at = net.flat().astype(float) - flat, flat.astype(float), 0
    assert net.flat().shape == flat.shape and np.count_nonzero(moved) > 1000
    for name, shape in lm.SHAPES.items():
        size = int(np.prod(shape))
        some = at + np.flatnonzero(moved[at : at + size])
        for i in [*rng.choice(some, 12), *rng.integers(at, at + size, 3)]:
            step = np.zeros(len(flat))
            step[i] = 1e-4
            slope = (mean(start + step) - mean(start - step)) / 2e-4
            assert moved[i] == pytest.approx(lm.RATE * slope / np.sqrt(0.01 + slope * slope), abs=2e-5), name
        at += size


def test_words_equal_splitting_each_text():
    from docloom.llm.lm_scoring import Words

    texts = ["skipped", None, "", " \t\n\x0b\x0c\r", "  Ab cD\x0bab ", "x\x1cy\x85z\xa0É é\u3000日本", "one", None, "\x00 \x00"]
    for given in (texts, texts[:3], ["a b"], []):
        met = Words.of(pa.array(given, pa.string()).slice(1 if len(given) > 1 else 0))
        want = [(x or "").encode().lower().split() for x in given[1 if len(given) > 1 else 0 :]]
        assert met.sizes.tolist() == [len(x) for x in want]
        assert met.distinct.cast(pa.binary()).take(pa.array(met.codes)).to_pylist() == [w for x in want for w in x]


def test_running_words_are_no_python_objects(monkeypatch):
    """Training takes less memory a running word than one Python object each would."""
    import tracemalloc
    from types import SimpleNamespace

    import docloom.llm.lm_scoring as lm

    n = 240_000
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = lm._train_round(SimpleNamespace(value=Network().flat()), SimpleNamespace(value=["abc"]))
    batches = lambda n: iter([pa.record_batch({"doc_id": [1], "text": ["abc xyz " * (n // 2)]})])

    def peak(n):
        tracemalloc.start()
        assert list(run(batches(n)))[0].column("weight").to_pylist() == [n]
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    peak(10)  # imports
    assert (peak(n) - peak(4096)) / n < 30, (peak(n), peak(4096))


def test_language_model_prefers_seen_order(spark, none):
    import random

    rng = random.Random(2)
    phrases = ["the cat sat on the mat today", "a red boat went down the river", "she reads old books at night"]
    rows = [(i, " ".join(rng.choices(phrases, k=40))) for i in range(200)]
    mixed = rows[0][1].split()
    rng.shuffle(mixed)
    rows += [(900, " ".join(mixed)), (901, None), (902, "")]
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got[0].mean_log_likelihood > got[900].mean_log_likelihood + 0.5
    assert got[901].n_words == 0 and got[901].log_likelihood == 0 and got[902].mean_log_likelihood is None
    assert all(r.n_words == len(dict(rows)[k].split()) for k, r in got.items() if k < 900)
    assert score_documents(none).count() == 0


@pytest.mark.parametrize("frequent", [0, 100, 1 << 16])
def test_scores_equal_a_plain_forward_pass(spark, docs, rows, monkeypatch, frequent):
    """Each word by itself, its neighbours looked up one by one, its part counted over all words."""
    import docloom.llm.lm_scoring as lm

    monkeypatch.setattr(lm, "FREQUENT", frequent)
    kept = docs.select("doc_id", "text").where("doc_id is not null and doc_id not in (4, 47)")
    counts = lm.materialize(lm.count_words(kept), "words")
    model = lm.train(kept, counts)
    got = {r.doc_id: r for r in lm.score(kept, model).collect()}
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    texts = {r[0]: WORDS.findall(lower(r[1])) for r in rows if r[0] not in (None, 4, 47)}
    every = Counter(w for ws in texts.values() for w in ws)
    bucket = lambda w: lm.VOCAB - lm.BUCKETS + xxhash.xxh64_intdigest(w.encode(), 42) % lm.BUCKETS
    ids = {w: model.words.index(w) if w in model.words else bucket(w) for w in every}
    in_bucket = Counter()
    for w, n in every.items():
        in_bucket[ids[w]] += n
    p, at = {}, 0
    for name, shape in lm.SHAPES.items():
        p[name] = model.flat[at : at + int(np.prod(shape))].reshape(shape).astype(float)
        at += int(np.prod(shape))
    log_p = lambda x, i: x[i] - math.log(sum(math.exp(v) for v in x))
    for k, ws in texts.items():
        total = 0.0
        for i, w in enumerate(ws):
            near = [ids[ws[i + o]] if 0 <= i + o < len(ws) else lm.EDGE for o in lm.OFFSETS]
            h = np.tanh(p["bias"] + sum(p["words"][j][x] for j, x in enumerate(near)))
            first, second = divmod(ids[w], lm.DIGIT)
            total += log_p(h @ p["high"] + p["high_bias"], first) + log_p((h + p["digit"][first]) @ p["low"] + p["low_bias"], second)
            total += 0 if w in model.words else math.log(every[w] / in_bucket[ids[w]])
        assert got[k].n_words == len(ws) and got[k].log_likelihood == pytest.approx(total, rel=1e-4, abs=1e-3)
    assert len(got) == len(texts) and len(model.frequent) <= frequent


def test_rare_words_have_their_own_probability(spark):
    from collections import defaultdict

    from docloom.llm.lm_scoring import BUCKETS

    bucket, by_bucket = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) % BUCKETS, defaultdict(list)
    for i in range(3000):
        by_bucket[bucket(f"rare{i}")].append(f"rare{i}")
    often, once = next(ws for ws in by_bucket.values() if len(ws) > 1)[:2]
    known = " ".join(f"known{i}" for i in range(VOCAB - BUCKETS))
    rows = [(i, known) for i in range(60)] + [(100, f"known1 {often} known2"), (101, f"known1 {once} known2"), (None, f"known1 {once} known2"), (102, (often + " ") * 48), (103, "")]
    got = {(r.doc_id, r.n_words): r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    gap = got[100, 3].log_likelihood - got[101, 3].log_likelihood
    assert gap == pytest.approx(math.log(49 / 2), abs=1e-5)  # both have one bucket: only their counts tell them apart
    assert got[None, 3].log_likelihood == pytest.approx(got[101, 3].log_likelihood, abs=1e-5) and len(got) == 65
    hashed = spark.createDataFrame([(w,) for w in ("a", "ü", "日本", "x" * 99)], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("b"))
    assert all(r.b == bucket(r.w) for r in hashed.collect())


def shingles(text):
    w = WORDS.findall((text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_contained_items_equal_brute_force(docs, rows, items, none):
    tests = [(r.item_id, shingles(r.text)) for r in items.collect() if r.item_id is not None]
    want = set()
    for r in rows:
        own = shingles(r[1])
        want |= {(r[0], i, len(t), len(t & own)) for i, t in tests if t and r[0] is not None and 10 * len(t & own) >= 8 * len(t)}
    assert {tuple(r) for r in contained_items(docs, items).collect()} == want and want
    assert contained_items(none, items).count() == 0 and contained_items(docs, items.limit(0)).count() == 0


def test_contaminated_documents_go(docs, rows, items):
    out = remove_contaminated(docs, items)
    assert out.columns == docs.columns
    left = Counter(r.doc_id for r in out.collect())
    assert left == Counter(r[0] for r in rows if r[0] not in (44, 45))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = corpus_pipeline.materialize(docs, name)
        kept[name] = [r.doc_id for r in docs.collect()]
    good = {i for i in range(300) if i % 3}
    assert len(good - set(kept["quality_classifier"])) <= 3
    assert 301 not in kept["simhash"] and len(set(kept["simhash"])) == len(kept["simhash"])
    assert 300 not in kept["decontamination"] and len(kept["simhash"]) - len(kept["decontamination"]) == 1
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(kept["mixing"])
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_pipeline_equals_brute_force(spark, sf_dir):
    """All five stages in plain Python over the same tables."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    texts = {i: (r.text or "").encode() for i, r in rows.items()}
    model = plain_model(texts, spark.read.parquet(f"{sf_dir}/labels.parquet").collect())
    left = [i for i in sorted(rows) if model.score(statistics(texts[i])[None])[0] >= 0.3]
    prints = [(i, simhash_of(rows[i].text)) for i in left]
    left = [i for (i, _), c in zip(prints, chained(prints), strict=True) if i == c]
    tests = [shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.item_id is not None]
    left = [i for i in left if not any(t and 10 * len(t & shingles(rows[i].text)) >= 8 * len(t) for t in tests)]
    pieces = plain_mix([(i, rows[i].source, rows[i].text) for i in left], 256, 11, 64)
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i in left:
        text, rounds = rows[i].text or "", []
        places = [m.span() for m in WORDS.finditer(text)]
        for a, b in sorted((a, b) for _, _, a, b in pieces[i]):  # neighbouring ranges follow one another in the first round they fit
            at = next((r for r in rounds if r[-1][1] <= a), None)
            if at is None:
                rounds.append([(a, b)])
            elif at[-1][1] == a:
                at[-1] = (at[-1][0], b)
            else:
                at.append((a, b))
        if rounds:
            mixed = "\n".join(text[places[a][0] : places[b - 1][1]] for r in rounds for a, b in r)
            ids = [*tokenizer.encode(mixed, add_special_tokens=False).ids, 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want and len(want) > 50


def test_pipeline_of_no_documents(spark, sf_dir, tmp_path):
    import shutil

    import corpus_pipeline

    for name in ("labels", "benchmark"):
        shutil.copytree(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

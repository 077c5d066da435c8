"""Whitening, fill-in-middle and BPE against plain Python."""

import hashlib
import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import fill_in_middle as fim
from docloom.llm import whitening as wh
from docloom.llm.bpe import HeapEncoder, Vocabulary, decode, encode, unpack

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_sample(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_samples_equal_plain_python(spark, docs, rows, none):
    out = fim.fill_in_middle(docs).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    got = out.collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(plain_sample(r[0], r[1]) for r in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((r[0], r[1] or "") for r in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(none).count() == 0


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
def test_scan_over_any_blocks(block, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", block)
    rng = random.Random(block)
    letters = ["a", "é", "日", "😀", " ", "\n", "\t", "\x0b", "\x85", "\xa0", "<", "P", "S", "M", ">"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2000)] + ["<P", ">", "<S>", "<<M>", ""]
    columns = fim.transform([t.encode() for t in texts], list(range(len(texts))), 42, 50, 80)
    got = list(zip(range(len(texts)), *[c.to_pylist() for c in columns]))
    assert got == [plain_sample(i, t) for i, t in enumerate(texts)]


def test_a_very_long_text_is_cut_whole(spark):
    text = " ".join(f"wörd{i % 977}" for i in range(300_000)) + "\n"
    table = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string")
    got = sorted(tuple(r) for r in fim.fill_in_middle(table).collect())
    assert got == [plain_sample(i, text) for i in range(12)] and {r[2] for r in got} > {"plain"}


def test_draws_are_spread(spark):
    forms = Counter(r.form for r in fim.fill_in_middle(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))).collect())
    assert abs(forms["plain"] - 2000) < 200 and abs(forms["spm"] - 1600) < 200 and abs(forms["psm"] - 400) < 100


def plain_whitening(vectors):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((x * n - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, [int(((n * r - sums) ** 2).sum()) for r in x], centred, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("falling", [True, False])
def test_whitening_equals_a_full_decomposition(spark, falling):
    """Eigenvalues that fall fast are found by the power passes, those that don't by the full basis."""
    rng = np.random.default_rng(3)
    scale = 0.5 ** np.arange(24) if falling else np.linspace(1, 0.8, 24)
    vectors = (rng.standard_normal((700, 24)) * scale * 3) @ np.linalg.qr(rng.standard_normal((24, 24)))[0]
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 300, axis=0)])  # one vector is a third of all
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    n, deviations, centred, values, axes = plain_whitening(vectors)
    got = wh.by_component(wh.whiten(table)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    assert all(r.deviation == Decimal(deviations[r.vec_id]) for r in got)
    assert {round(r.identity_error, 9) for r in got} == {0}
    z = np.zeros((n, 8))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    want = centred @ axes[:, :8] / np.sqrt(values[:8])
    signs = np.sign((z * want).sum(axis=0))
    assert np.abs(z * signs - want).max() < 1e-8


def test_power_passes_stop_early_and_expand(spark, monkeypatch):
    seen, times = [], wh._times
    monkeypatch.setattr(wh, "_times", lambda found, basis: seen.append(basis.shape[1]) or times(found, basis))
    rng = np.random.default_rng(5)
    for scale, expected in ((0.01 ** np.arange(24), {16}), (np.ones(24), {16, 24})):
        rows = (rng.standard_normal((200, 24)) * scale * 1e4).tolist()
        table = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        seen.clear()
        wh.whiten(table)
        assert set(seen) == expected and len(seen) <= wh.PASSES + 1


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [2.0, 0.0, 1.0]), (3, [0.5, 0.25, -1.0]), (4, None), (5, []), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, "clash", 1, [1.0]) for r in rows], "vec_id long, embedding array<float>, x string, n int, whitened array<double>")
    got = wh.whiten(table).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "3", "None"]
    kept = [r[1] for r in rows[:4]]
    n, deviations, _, values, _ = plain_whitening(kept)
    assert Counter(int(r.deviation) for r in got) == Counter(deviations)
    assert {len(r.whitened) for r in got} == {int((values > 1e-9 * values.sum()).sum())} and {r.n for r in got} == {4}
    assert wh.by_component(wh.whiten(table.limit(0))).count() == 0
    equal = wh.whiten(table.where("vec_id = 1"))
    assert [(len(r.whitened), r.deviation, r.identity_error) for r in equal.collect()] == [(0, 0, 0.0)] * 2
    assert wh.by_component(equal).count() == 0
    far = wh.whiten(spark.createDataFrame([(1, [2.0**40]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert {int(r.deviation) for r in far} == {2**100}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library(spark, docs, rows, none, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    out = decode(encode(docs, tokenizer), tokenizer)
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()) == Counter(want)
    some = out.where("doc_id in (0, 60)").withColumn("list", unpack(F.col("ids"))).collect()
    assert all(r.list == np.frombuffer(r.ids, "<u4").tolist() for r in some)
    assert decode(encode(none, tokenizer), tokenizer).count() == 0


def test_merges_equal_the_library_on_odd_strings(tokenizer):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    letters = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日本", "😀", "'s", "'ll", "1", "23", "<|endoftext|>", "\0", "\x1c", "\x85", "　", "!?", "ing", "$", "'S", "aaaa"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["ab" * 200_000, " " * 5000 + "x", "x" + " " * 5000, "the quick " * 60_000]
    want = [x.ids for x in Tokenizer.from_file(tokenizer).encode_batch_fast(texts, add_special_tokens=False)]
    encoder = HeapEncoder(tokenizer)
    assert [x.tolist() for x in encoder.encode_batch(texts)] == want
    assert [x.tolist() for x in encoder.encode_batch(texts)] == want  # from the table of words


def test_decoding_of_any_ids(spark, tokenizer):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(tokenizer), np.random.default_rng(4)
    lists = [rng.integers(0, 50_257, rng.integers(0, 50)) for _ in range(300)]
    table = spark.createDataFrame([(i, bytearray(x.astype("<u4").tobytes())) for i, x in enumerate(lists)] + [(None, None)], "n long, ids binary")
    got = {r.n: r.decoded for r in decode(table, tokenizer).collect()}
    assert got.pop(None) == ""
    assert got == {i: library.decode(x.tolist(), skip_special_tokens=False) for i, x in enumerate(lists)}


def test_a_tokenizer_of_another_kind_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_rows_of_one_id_make_several_files(spark, tokenizer, tmp_path, monkeypatch):
    from docloom.llm import token_output

    monkeypatch.setattr(token_output, "PER_FILE", 4000)
    rows = [(7, f"text {i} " * 20) for i in range(200)] + [(None, f"no id {i} " * 20) for i in range(200)] + [(i, "a b c") for i in range(200)]
    manifest = token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer, f"file://{tmp_path}/t", length=64, rows=8)
    files = manifest.collect()
    assert len(files) > 10 and max(f.n_docs for f in files) < 250
    got = sorted(token_output.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))


def test_a_long_text_goes_through_the_encoders_in_pieces(spark, tokenizer):
    from docloom.llm.token_output import Encoder

    text = " ".join(f"wörd{i % 9973}, x" for i in range(120_000))
    whole = Encoder(tokenizer)._whole([text])[0].tolist()
    assert len(text) > 3 << 18 and Encoder(tokenizer).encode(text).tolist() == whole == HeapEncoder(tokenizer).encode(text).tolist()


def test_chats_of_many_turns(spark):
    from docloom.llm.chat_format import format_chats, read_loss, read_turns

    n = 20_000
    role = F.when(F.col("id") % 3 == 0, "user").otherwise("assistant")
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("é<|"), "id").alias("text"))
    got = format_chats(turns).select(read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    said = [("user" if i % 3 == 0 else "assistant", f"é<|{i}") for i in range(n)]
    assert [tuple(t) for t in got.turns] == said and got.loss == [t for r, t in said if r == "assistant"]

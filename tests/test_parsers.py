"""Parsers fed whole, cut at every place, as tables and as streams; state that ends."""

import json
import random
import re
import time

import pytest

from docloom.streaming import parsers as P

ITEMS = """Here they are
<<<FAQ
근거: page 3
질문: What is it?
답변: A thing
of two lines
>>>
noise
<<<FAQ
질문: second
답변: yes > no  
<<<FAQ
근거: a
질문: third\r
답변: >> it
>>> tail
<<<FAQ
답변: open to the end"""
PAIRS = '{"note": "\\"updates\\"", "x": 1, ""updates"updates" : { "a": "one, \\"two\\" }", "b" : 12 , "c": [1, {"d": "]"}],"e":{"f":null}, "g": true\n}, "z": 1}'


def run(parser, pieces):
    state, events = parser.start, []
    for p in pieces:
        state, some = parser.feed(state, p)
        assert json.loads(json.dumps(state)) == state
        events += some
    return events + parser.finish(state)


def joined(events):
    """Events with the deltas that stand together joined."""
    out = []
    for kind, name, text in events:
        if kind == "delta" and out and out[-1][0] == "delta":
            out[-1] = (kind, name, out[-1][2] + text)
        else:
            out.append((kind, name, text))
    return out


def test_items_and_pairs_whole():
    items = [json.loads(t) for k, _, t in run(P.ItemParser, [ITEMS]) if k == "item"]
    assert items == [
        {"evidence": "page 3", "question": "What is it?", "answer": "A thing of two lines"}, {"evidence": "", "question": "second", "answer": "yes > no"},
        {"evidence": "a", "question": "third", "answer": ">> it"}, {"evidence": "", "question": "", "answer": "open to the end"},
    ]
    assert [(n, json.loads(t)) for _, n, t in run(P.PairParser, [PAIRS])] == [("a", 'one, "two" }'), ("b", 12), ("c", [1, {"d": "]"}]), ("e", {"f": None}), ("g", True)]
    for bad in ('"updates": {1: 2, "a": 3}', '"updates": {"a" 3}', '"updates": {"a": nope, "b": 1}', '"updates" {"a": 1}', '"updates": {"a": 1'):
        assert run(P.PairParser, [bad]) == []


@pytest.mark.parametrize(("parser", "text"), [(P.ItemParser, ITEMS), (P.PairParser, PAIRS)])
def test_any_cut_gives_the_same(parser, text):
    want = joined(run(parser, [text]))
    for i in range(len(text)):
        assert joined(run(parser, [text[:i], text[i:]])) == want
    assert joined(run(parser, list(text))) == want
    rng = random.Random(1)
    for _ in range(100):
        at = sorted(rng.sample(range(len(text)), 9))
        assert joined(run(parser, [text[a:b] for a, b in zip([0, *at], [*at, len(text)])])) == want


def pieces_of(text, size):
    return [(i, text[at : at + size]) for i, at in enumerate(range(0, len(text), size))]


def test_tables(spark):
    rows = [("a", *p) for p in pieces_of(ITEMS, 5)] + [("b", *p) for p in pieces_of(ITEMS, 11)] + [(None, 0, ITEMS), ("c", 1, "after a gap"), ("d", 0, "<<<FAQ\n"), ("d", 1, None), ("d", 2, "답변: late"), ("e", None, "x")]
    rows += rows[:4]  # pieces that came again
    table = spark.createDataFrame(rows, "k string, i int, t string").repartition(5)
    got = {}
    for r in sorted(P.parse_pieces(table, "k", "i", "t").collect(), key=lambda r: r.at):
        got.setdefault(r.key, []).append((r.kind, r.name, r.text))
    want = joined(run(P.ItemParser, [ITEMS]))
    assert {k: joined(v) for k, v in got.items()} == {"a": want, "b": want, None: want, "d": run(P.ItemParser, ["<<<FAQ\n"])}
    assert P.parse_pieces(table.limit(0), "k", "i", "t", "pairs").count() == 0


def stream(spark, tmp_path, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    return folder, spark.readStream.schema(schema).json(str(folder))


def put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def step(frame, tmp_path, out):
    # timers of processing time ask for another batch for ever
    frame.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = frame.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    assert q.awaitTermination(60)


def test_a_stream_of_pieces_whose_state_ends(spark, tmp_path):
    folder, source = stream(spark, tmp_path, "k string, i int, t string")
    frame, out = P.parse_pieces(source, "k", "i", "t", "pairs", ttl_seconds=12), []
    put(folder, "1.json", [{"k": "a", "i": 1, "t": '{"x": 1'}, {"k": "b", "i": 0, "t": '"updates": {"y": "'}, {"k": "c", "i": 0, "t": '"updates": {"z": 1, '}])
    step(frame, tmp_path, out)
    put(folder, "2.json", [{"k": "a", "i": 0, "t": '"updates": '}, {"k": "a", "i": 2, "t": "2, "}, {"k": "a", "i": 1, "t": "again"}])
    step(frame, tmp_path, out)
    assert sorted((r.key, r.name, r.text) for r in out) == [("a", "x", "12"), ("c", "z", "1")]
    time.sleep(13)
    put(folder, "3.json", [{"k": "b", "i": 1, "t": '2", "w": 1}'}, {"k": "a", "i": 3, "t": '"v": 1}'}, {"k": "c", "i": 0, "t": '"updates": {"new": 1}'}])
    step(frame, tmp_path, out)
    # what b and a began is gone with their state; c starts anew
    assert sorted((r.key, r.name, r.text, r.at) for r in out[2:]) == [("c", "new", "1", 0)]


def test_sessions_expire(spark, tmp_path):
    folder, source = stream(spark, tmp_path, "k string, i int, t string")
    frame, out = P.keep_items(source, "k", "i", "t", most=2, ttl_seconds=2), []
    put(folder, "1.json", [{"k": "a", "i": n, "t": t} for n, t in enumerate(["x", "y", "z", "y"])])
    step(frame, tmp_path, out)
    assert [tuple(r) for r in out] == [("a", ["z", "y"], False)]
    time.sleep(3)
    put(folder, "2.json", [{"k": "b", "i": 0, "t": "q"}])
    step(frame, tmp_path, out)
    assert ("a", [], True) in [tuple(r) for r in out[1:]]
    put(folder, "3.json", [{"k": "a", "i": 9, "t": "w"}])
    step(frame, tmp_path, out)
    assert ("a", ["w"], False) in [tuple(r) for r in out]
